"""Operators 5, 7, 8, 10 against brute force on small tables with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import same
from pagelore.llm import decontaminate, exact_dedup, ngram_join, substring_dedup
from pagelore.llm._common import mix

WS = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, __n string, n string"


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    out = []
    for g in range(12):
        base = words(r, r.choice([1, 2, 5, 12, 30, 80, 300]))
        for _ in range(r.choice([1, 2, 4, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = f"x{r.randrange(50)}"
            out.append(" ".join(w) if g % 3 else "\n".join(w))
    passage = " ".join(words(r, 60))
    out += [" ".join(words(r, 90)) + " " + passage + " " + " ".join(words(r, 40)) for _ in range(4)]
    near = words(r, 100)
    out += [" ".join(near), " ".join([*near[:50], "edited", *near[51:]])]
    out += ["", None, "  \n\t", "Word", "WORD", "a b", "A  b", "same text", "same text"]
    rows = [(i, t, "en", "a", "b") for i, t in enumerate(out)]
    rows += [(None, "text without an id", "en", None, None), rows[0], (5000, rows[0][1], None, "z", "z")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, corpus, empty):
    got = sorted(map(tuple, exact_dedup.groups(docs).collect()), key=repr)
    assert len(got) == len(corpus)
    groups = {}
    for i, t, *_ in corpus:
        groups.setdefault(hashlib.sha256(WS.sub("", t or "").encode()).hexdigest(), []).append((i, t or ""))
    for i, keep, size, kept, sha in got:
        mine = groups[sha]
        best = min(mine, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        assert keep == best[0] and size == len(mine) and (i in [m[0] for m in mine])
        assert not kept or i == keep
    assert sum(g[3] for g in got) == len(groups)  # one row of each group stays, repeated rows too
    assert exact_dedup.groups(empty).count() == 0


def test_drop_copies_keeps_columns(docs, corpus, empty):
    got = exact_dedup.drop_copies(docs).collect()
    assert got[0].__fields__ == docs.columns
    keys = [WS.sub("", r.text or "") for r in got]
    assert len(keys) == len(set(keys)) and set(keys) == {WS.sub("", t or "") for _, t, *_ in corpus}
    assert exact_dedup.drop_copies(empty).count() == 0


def test_filters_have_no_false_negatives(spark):
    ids = spark.range(20_000).select((F.col("id") % 15_000).alias("h")).select(F.xxhash64("h").alias("h"))
    maybe = exact_dedup.repeated_filter(ids, 20_000)
    marked = ids.withColumn("m", maybe("h")).groupBy("h").agg(F.count("*").alias("n"), F.bool_or("m").alias("m")).collect()
    assert all(r.m for r in marked if r.n > 1) and sum(r.m for r in marked if r.n == 1) < 200
    tiny = exact_dedup.repeated_filter(ids, 20_000, max_filter_bytes=1 << 17)  # a full filter still misses none
    assert all(r.m for r in ids.withColumn("m", tiny("h")).groupBy("h").agg(F.count("*").alias("n"), F.bool_and("m").alias("m")).collect() if r.n > 1)


def shingle_set(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, linked):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=repr)


def test_ngram_components(docs, corpus, empty):
    got = sorted(map(tuple, ngram_join.link_components(docs).collect()), key=repr)
    assert got == brute_components(corpus, lambda a, b: 100 * len(a & b) >= 90 * len(a | b))
    assert ngram_join.link_components(empty).count() == 0


def test_ngram_many_sizes(spark):
    """Near copies around every class border and of every small size."""
    r = random.Random(5)
    rows = []
    for n in [*range(1, 60), 75, 100, 140, 200, 330]:
        base = words(r, n + 2, 10_000)
        for k in range(4):
            w = list(base)
            for _ in range(k if n > 25 else min(k, 1)):
                at = r.randrange(len(w))
                w[at : at + 1] = [] if r.random() < 0.4 and len(w) > 3 else [f"e{r.randrange(10**6)}"]
            rows.append((len(rows), " ".join(w)))
    got = sorted(map(tuple, ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_components(rows, lambda a, b: 100 * len(a & b) >= 90 * len(a | b))


def test_size_classes():
    for n in range(1, 3000):
        number, top = ngram_join.size_class(n)
        assert n <= top and (n == 1 or ngram_join.size_class(n - 1)[0] in (number, number - 1))
        assert n * 100 // 90 <= ngram_join.size_class(top + 1)[1]  # a partner is in this class or the next


def test_keep_one_each(docs, empty):
    comp = {(r.doc_id, r.component_id) for r in ngram_join.link_components(docs).collect()}
    kept = ngram_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for _, c in comp if c is not None}
    assert ngram_join.keep_one_each(empty).count() == 0


def test_op5_and_op10_sql(spark, sf_dir, duck):
    assert same(ngram_join.op5_ngram_join(spark, sf_dir), duck.sql(ngram_join.SQL)) == 200
    assert same(exact_dedup.op10_exact_dedup(spark, sf_dir), duck.sql(exact_dedup.SQL)) == 200


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs away from it all today"), (2, "two words"), (3, ""), (4, None), (5, "one two three four five six"), (None, "an item without any id but with enough words in it"), (1, "the quick brown fox jumps over the lazy dog and runs away from it all today")]


def contained(item, text):
    strip = lambda t: [w for w in (re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w) for w in re.findall("[^\x20\x09-\x0d]+", (t or "").lower())) if w]
    a, b = strip(item), strip(text)
    k = min(5, len(a))
    s = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)} if k else set()
    have = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
    return (len(s), len(s & have)) if s and 5 * len(s & have) >= 4 * len(s) else None


def test_decontamination(spark, docs):
    r = random.Random(9)
    texts = ["", None, ITEMS[0][1].upper() + "!!", " ".join(words(r, 5000)) + " " + ITEMS[0][1] + " " + " ".join(words(r, 3000)), "has TWO, words. in it", ITEMS[0][1].replace("lazy", "sleepy"), "one two three four five", "(one two three four five six)", ITEMS[5][1], " ".join(words(r, 40))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, ITEMS[0][1])]
    got = sorted(map(tuple, decontaminate.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"), block_items=3).collect()), key=repr)
    want = sorted(((d, i, *c) for d, t in rows for i, x in ITEMS if (c := contained(x, t))), key=repr)
    assert got == want
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.drop_contaminated(frame, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((d for d, t in rows if not any(contained(x, t) for _, x in ITEMS)), key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(frame, none).count() == 0 and decontaminate.drop_contaminated(frame, none).count() == len(rows)


def test_op8_sql(spark, sf_dir, duck):
    same(decontaminate.op8_decontamination(spark, sf_dir), duck.sql(decontaminate.SQL))


def test_repeats(docs, corpus, empty):
    got = substring_dedup.repeats(docs).collect()
    texts = {i: t or "" for i, t, *_ in corpus}
    tokens = {i: t.lower().split() for i, t in texts.items()}
    size = substring_dedup.MIN_WORDS + 1
    grams = {}
    for i, w in tokens.items():
        for j in range(len(w) - size + 1):
            grams.setdefault(tuple(w[j : j + size]), set()).add(i)
    exact = {i for s in grams.values() if len(s) > 1 for i in s}
    found = {r.doc_id for r in got}
    assert exact <= found
    lines = [(i, {tuple(p[j : j + 5]) for j in range(len(p) - 4)}) for i, t in texts.items() for p in [line.lower().split() for line in t.split("\n")] if len(p) >= 50]
    near = {i for a, (i, s) in enumerate(lines) for b, (j, t) in enumerate(lines) if a != b and i != j and 5 * len(s & t) >= 4 * len(s | t)}
    assert near <= found and found <= near | exact
    by = {}
    for r in got:
        by.setdefault((r.kind, r.component), []).append(r)
    for rows in by.values():
        assert len(rows) > 1 and sum(not r.removed for r in rows) == 1 and len({r.keep_doc_id for r in rows}) == 1
    assert substring_dedup.repeats(empty).count() == 0


def test_short_paragraphs(spark, tmp_path):
    """The query bands lines from five words up: equal ones, and near ones of a similarity of 0.8."""
    r = random.Random(11)
    rows, lines = [], []
    for n in [4, 5, 6, 7, 8, 9, 12, 20, 30, 45, 49]:
        base = words(r, n, 10**6)
        for edit in (None, None, 0, n // 2):
            w = list(base)
            if edit is not None:
                w[edit] = f"edited{len(rows)}"
            lines.append(w)
            rows.append((len(rows), "\n".join(" ".join(x) for x in (words(r, 7, 10**6), w, words(r, 3, 10**6)))))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    want = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and 5 * len(a & b) >= 4 * len(a | b)}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = substring_dedup.op7_substring_dedup(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == want and len(want) > 24
    assert all(x.kind == "paragraph" and x.begin == 7 and x.end == 7 + len(lines[x.doc_id]) for x in got)


def test_every_shortest_passage(spark):
    """51 equal words are found whatever the words, and 50 aren't."""
    r = np.random.default_rng(2)
    size = substring_dedup.MIN_WORDS + 1
    for _ in range(3000):
        own = mix(r.integers(0, 1 << 62, size).astype(np.uint64))
        if r.random() < 0.1:
            own = np.tile(own[: r.integers(1, 9)], size)[:size]
        two = [np.concatenate([mix(r.integers(0, 1 << 62, r.integers(0, 30)).astype(np.uint64)), own, mix(r.integers(0, 1 << 62, r.integers(0, 30)).astype(np.uint64))]) for _ in range(2)]
        found = []
        for h in two:
            a = next(i for i in range(len(h)) if (h[i : i + size] == own).all())
            found.append({x - a for x in substring_dedup.anchors(h, np.array([0, len(h)])).tolist() if a <= x and x + substring_dedup.WINDOW <= a + size})
        assert found[0] & found[1]

    # passages with a single place, or with places close together: a stretch of one window
    few, rows = random.Random(4), []
    while len(rows) < 40:
        passage = words(few, size, 10**6)
        two = [words(few, 20, 10**6) + passage + words(few, 20, 10**6) for _ in range(2)]
        at = [np.array([x - 20 for x in substring_dedup.anchors(substring_dedup.Words(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))])).hash, np.array([0, len(w)])).tolist() if 20 <= x <= 20 + size - substring_dedup.WINDOW]) for w in two]
        both = np.intersect1d(*at)
        if both[-1] - both[0] < 12:
            rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(two)]
    rows += [(1000 + i, " ".join(words(few, 20, 10**6) + passage[:50] + words(few, 20, 10**6))) for i in range(1)]
    got = {(x.doc_id, x.begin, x.end) for x in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.kind == "passage"}
    assert got == {(i, 20, 20 + size) for i in range(40)}


def test_long_windows_leave_in_small_batches():
    """Dense runs make many times the rows of their words; a task holds few of them."""
    words = " ".join(f"w{i % 997}" for i in range(20_000))
    runs = [{"node": i, "lo": 12 * i, "hi": 12 * i + 12} for i in range(1600)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([words] * 3), "k": [1, 2, 3], "runs": [runs] * 3})
    got = list(substring_dedup._long_grams(iter([batch])))
    rows = sum(b.num_rows for b in got)
    assert rows > 150_000 and max(b.num_rows for b in got) <= 1 << 16
    want = [(k, r["node"], at) for k in (1, 2, 3) for r in runs for at in range(max(0, r["lo"] - 39), min(20_000, r["hi"] + 39) - 50)]
    assert [(k, node, at) for b in got for k, node, at in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))] == want


def test_beyond_the_broadcast_bound(docs, monkeypatch):
    """Filters and split joins in place of broadcasts: the same rows."""
    key = lambda r: (r.doc_id is not None, r.doc_id, r.kind, r.begin, r.end, r.removed)
    found = sorted(map(key, substring_dedup.repeats(docs, 5).collect()), key=repr)
    left = sorted(map(repr, ngram_join.keep_one_each(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    assert sorted(map(key, substring_dedup.repeats(docs, 5).collect()), key=repr) == found
    assert sorted(map(repr, ngram_join.keep_one_each(docs).collect())) == left


def test_odd_column_names(spark):
    """Every operator that keeps columns keeps those with dots, quotes and clashing names."""
    names = ["doc_id", "text", "a.b", "IDS_", "pl_sha", "PL_KEY", "we`ird", "__pl_gone"]
    rows = [(i, f"some text of words number {i % 3}", *"uvwxyz") for i in range(6)] + [(None, None, *"uvwxyz")]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id long", *("`" + n.replace("`", "``") + "` string" for n in names[1:])]))
    items = spark.createDataFrame([(1, "some text of words number 2")], "item_id long, text string")
    from pagelore.llm import sentencepiece_codec

    for out, n in ((exact_dedup.drop_copies(frame), 4), (ngram_join.keep_one_each(frame), 4), (decontaminate.drop_contaminated(frame, items), 5)):
        assert out.columns == names and out.count() == n
    assert sentencepiece_codec.encode(frame.withColumnRenamed("IDS_", "IDS")).columns == [*(n for n in names if n != "IDS_"), "ids", "n_tokens"]
