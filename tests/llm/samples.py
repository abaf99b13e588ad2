"""Small tables with the awkward cases every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, kept boolean, id long, words string, n long"
WORDS = {
    "en": "the of and to in a is that river stone walked slowly under bright morning light before anyone".split(),
    "de": "der die und in den von zu das fluss stein ging langsam unter hellem morgenlicht bevor jemand".split(),
    "fr": "de la le et les des en un fleuve pierre marchait lentement sous lumière claire avant quelqu'un".split(),
    "es": "de la que el en y los del río piedra caminaba despacio bajo luz clara antes alguien".split(),
}


def prose(rng, lang, count):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(count))


def documents(count=120, seed=5):
    """Prose in four languages with copies, near copies, repeated rows, nulls, blanks and one very long text."""
    rng = random.Random(seed)
    texts = []
    for k in range(count):
        lang = rng.choice(list(WORDS))
        if k % 9 == 4 and texts:
            texts.append(texts[rng.randrange(len(texts))])
        elif k % 9 == 7 and texts:
            text, lang = texts[rng.randrange(len(texts))]
            parts = text.split(" ")
            if len(parts) > 3:
                parts[rng.randrange(len(parts))] = "changed"
            texts.append((" \n".join(parts[:2]) + " " + " ".join(parts[2:]), lang))
        else:
            texts.append((prose(rng, lang, rng.choice([1, 3, 4, 5, 6, 40, 80])), lang))
    texts += [(None, "en"), ("", "en"), (" \t\r\n\x0b\x0c", None), ("#$% 12 !!", "de"), ("Ünï 😀 çödé", "fr"), (prose(rng, "en", 60000), "en"), ("x" * 300000, "en"), (texts[0][0], None)]
    rows = [(k, t, lang, f"src{0 if k % 3 else k % 5}", None if t is None else len(t)) for k, (t, lang) in enumerate(texts)]
    rows.append(rows[1])
    rows.append((None, "a row without a key but with enough words", None, None, None))
    return rows


def frame(spark, rows):
    """The rows as documents, with further columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 1, 0.5, False, 9, "w", 7) for r in rows], SCHEMA)
