"""The pipeline against brute force on what its predecessor stages keep."""

import re

import corpus_pipeline
from pagelore.llm import sentencepiece_codec, toxicity
from pagelore.llm._common import materialize, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), f"t-{name}"))
    rows = [{r.doc_id: r.asDict() for r in k.collect()} for k in kept]
    assert all(k.columns == columns for k in kept[:-1]) and [len(r) for r in rows] == [k.count() for k in kept]

    g = toxicity.train(docs, table(spark, sf_dir, "labels"))
    assert set(rows[1]) == {i for i, r in rows[0].items() if toxicity.text_score(r["text"], g, {}) < 0.5}

    best = {}
    for i, r in rows[1].items():
        k = re.sub("[\x20\x09-\x0d]", "", r["text"] or "")
        best[k] = min(best.get(k, (0, 10**9)), (-len(r["text"] or ""), i))
    assert set(rows[2]) == {i for _, i in best.values()}

    def shingles(t, k):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {i: shingles(r["text"], 3) for i, r in rows[2].items()}
    low = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(3):
        for i in ids:
            for j in ids:
                if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    assert set(rows[3]) == {i for i in ids if low[i] == i}

    def stripped(t):
        return [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) if w]

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    items = [w for r in table(spark, sf_dir, "benchmark").collect() if (w := stripped(r.text))]
    clean = set()
    for i, r in rows[3].items():
        have = {k: grams(stripped(r["text"]), k) for k in range(1, 6)}
        if not any(5 * len(grams(w, min(5, len(w))) & have[min(5, len(w))]) >= 4 * len(grams(w, min(5, len(w)))) for w in items):
            clean.add(i)
    assert set(rows[4]) == clean

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.public_model())
    assert all(r["ids"] == library.encode(rows[4][i]["text"] or "") for i, r in rows[5].items()) and set(rows[5]) == set(rows[4])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(rows[5])


def test_empty_and_odd_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, None)], docs.schema)
    for part in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            part = materialize(stage(spark, part, sf_dir), "t")
        assert part.count() <= 4
