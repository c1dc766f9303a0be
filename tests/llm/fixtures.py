"""Small tables with every awkward case, written as Parquet."""

import random

WORDS = {
    "en": "the of and to in is that for with on are this be by from thing water house river stone light".split(),
    "fr": "le la les des une est que pour dans avec sur aux maison rivière pierre lumière été où être".split(),
    "de": "der die das und ist nicht mit für auf dem ein haus fluss stein licht über schön größe".split(),
}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, fingerprint string, kept string, column0 string, ord string"


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + (r.choice(WORDS[lang]) if r.random() < 0.5 else "") for _ in range(n))


def documents(spark, n=90, seed=1):
    """Prose with copies, near copies, repeated rows, empty, null and blank texts, personal data, licences and very long texts."""
    r = random.Random(seed)
    passage = prose(r, "en", 30)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        text = prose(r, lang, r.randint(1, 120))
        if i % 9 == 0:
            text += " " + passage
        if i % 10 == 3:
            text = rows[r.randrange(len(rows))][1]
        if i % 10 == 7 and rows[-2][1]:
            text = rows[-2][1] + " tail"
        if i % 13 == 0:
            text += " mail jane.doe%d@mail.example.com or +1 (988) 555-24%02d, then (988) 555-24%02d, from 10.1.2.%d with 4111 1111 1111 1111" % (i, i, i, i)
        if i % 11 == 0:
            text += " Released under the MIT License. Apache License, Version 2.0"
        rows.append((i, text, lang, f"s{i % 4}" if i % 8 else "hot"))
    rows += [(n, None, "en", "s0"), (n + 1, "", None, None), (n + 2, " \t\n", "en", "s1"), (n + 3, "123 456 !!", None, "s2"), (n + 4, "x", "en", ""), (n + 5, "日本語 é 🙂 \x00", "en", None), (None, "no id at all", "en", "s0"), (None, passage, None, None), (None, passage, None, None)]
    rows += [(n + 6, prose(r, "fr", 20_000), "fr", "s3"), (n + 7, "a" * 150_000, "en", "s3"), rows[5], rows[5], (6, "another text of id six", "en", "s0")]
    full = [(*x, None if x[1] is None else len(x[1]), "z", None, "f", "k", "c", "o") for x in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def write(spark, path, docs, labels=None, embeddings=None):
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = labels if labels is not None else spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    if embeddings is None:
        r = random.Random(2)
        rows = [(i, [r.gauss(0, 1) for _ in range(8)], i % 3) for i in range(300)]
        rows += [(400 + i, rows[0][1], 0) for i in range(20)] + [(500, None, 1), (550, [None] + [0.0] * 7, 1), (600, [float("nan")] * 8, 1), (650, [float("inf")] + [0.0] * 7, 1), (None, [1.0] * 8, 1), rows[7], rows[50]]
        embeddings = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    embeddings.repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return str(path)
