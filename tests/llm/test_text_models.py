"""Operators 1, 2, 3, 4, 6, 9."""

import gc
import hashlib
import io
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import same
from pagelore.llm import chat_format, html_extract, quality, sentencepiece_codec, token_planes, toxicity

ODD = ["", None, " ", "a", "  two  spaces ", "▁mark▁", "\n\t\r", "é́ 日本語 😀", "x" * 3000 + " " + "ab" * 700, "<s> </s> <unk> <0x41>", "null\x00byte"]


def frame(spark, texts, extra=True):
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "no id", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


# ------------------------------------------------------------------ 2


def test_sentencepiece_equals_the_library(spark, duck):
    import sentencepiece

    path = sentencepiece_codec.public_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + [r[0] for r in duck.sql("SELECT text FROM documents").fetchall()]
    got = sentencepiece_codec.encode(frame(spark, texts)).collect()
    assert sorted(got[0].__fields__) == ["doc_id", "ids", "n_tokens", "text"] and len(got) == len(texts) + 1
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert back[i] == library.decode(library.encode(t or ""))
    for r in sentencepiece_codec.digest(frame(spark, texts)).collect():
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = np.array(library.encode(text), "<u4")
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.round_trip == ("▁" not in text)


def test_viterbi_is_the_best_path():
    m = sentencepiece_codec.Model(sentencepiece_codec.public_model())
    r = random.Random(1)
    words = ["▁" + "".join(r.choices("thearnio", k=7)) for _ in range(40)]
    table = m.table()
    for w, ids in zip(words, m.viterbi(words), strict=True):
        best = {0: 0.0}
        for e in range(1, len(w) + 1):
            best[e] = max(best[s] + (m.scores[table[w[s:e]]] if w[s:e] in table else -np.inf) for s in range(max(0, e - m.longest), e))
        assert "".join(m.pieces[i] for i in ids) == w and np.isclose(m.scores[ids].sum(), best[len(w)])
        assert m.merges([w])[0] == m._long_word(w)


# ------------------------------------------------------------------ 4


@pytest.mark.parametrize("layout", [token_planes.BITS, token_planes.BYTES])
def test_planes(layout):
    r = np.random.default_rng(0)
    for n in (1, 7, 64, 1000):
        ids = r.integers(0, 50257, n).astype(np.uint32)
        planes = 16 if layout == token_planes.BITS else 2
        assert (token_planes.from_planes(token_planes.to_planes(ids, layout, planes), n, layout) == ids).all()


def test_planes_of_every_bit():
    ids = np.random.default_rng(3).integers(0, 1 << 32, 1000, dtype=np.uint64).astype(np.uint32)
    planes = token_planes.to_planes(ids, token_planes.BITS, 32)
    assert planes == [np.packbits([int(x) >> i & 1 for x in ids], bitorder="little").tobytes() for i in range(32)]
    assert (token_planes.from_planes(planes, 1000, token_planes.BITS) == ids).all()


def test_tasks_of_a_worker_share_an_encoder(monkeypatch):
    """What one task has met the library doesn't encode again for the next one."""
    first = token_planes.encoder(token_planes.public_vocabulary())
    want = first.encode(["some words, met twice", "and others"])
    second = token_planes.encoder(token_planes.public_vocabulary())
    asked = []
    monkeypatch.setattr(second, "whole", lambda texts: asked.extend(texts) or [])
    got = second.encode(["and others", "some words, met twice"])
    assert not asked and [x.tolist() for x in got[::-1]] == [x.tolist() for x in want]


def test_pieces_are_cut_as_by_the_expression():
    # the cut in arrays is the expression's; in small memory ids stay the library's
    pick = np.random.default_rng(5)
    chars = np.array([*"''''  \n\tstmdrevlaLL9.\xe9\xb2\u2019"])
    texts = ["".join(pick.choice(chars, n)) for n in pick.integers(0, 60, 3000)]
    joined = "\0".join(texts) + "\0"
    at = [*token_planes.pieces(np.frombuffer(joined.encode("utf-16-le"), "<u2")).tolist(), len(joined)]
    assert [joined[a:b] for a, b in zip(at, at[1:])] == [p for t in texts for p in [*token_planes._PIECES.findall(t), "\0"]]
    e = token_planes.Encoder(token_planes.public_vocabulary())
    e.memory = token_planes.PieceMemory(1 << 18, e.type)
    for _ in range(2):
        for i in range(0, len(texts), 100):
            assert [x.tolist() for x in e.encode(texts[i : i + 100])] == [x.ids for x in e.library.encode_batch(texts[i : i + 100], add_special_tokens=False)]


def test_remembered_pieces_are_small():
    e = token_planes.Encoder(token_planes.public_vocabulary())
    e.encode(["warm up"])
    texts = ["".join(f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}ed" for i in range(j, j + 1000)) for j in range(0, 40_000, 1000)]
    tracemalloc.start()
    for t in texts:
        e.encode([t])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 * 40_000


def test_equal_hashes_of_unlike_pieces(monkeypatch):
    monkeypatch.setattr(token_planes, "_piece_hashes", lambda units, at, size: size.astype(np.uint64) & np.uint64(3))
    e = token_planes.Encoder(token_planes.public_vocabulary())
    texts = ["one two", "two one", "six ten", "a much longer word", "", "one two"]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_words_end_with_their_task(spark):
    """A worker lives on after its task; it keeps the model and no words."""

    def left(batches):
        for _ in batches:
            memory = [m.memory for m in sentencepiece_codec._models.values()]
            yield pa.RecordBatch.from_pydict({"models": [len(memory)], "words": [sum(len(x.young) + len(x.old) for x in memory)]})

    texts = spark.range(400).selectExpr("id AS doc_id", "concat('word', id, ' text') AS text").repartition(4)
    for run in (sentencepiece_codec.encode, sentencepiece_codec.digest):
        assert run(texts).count() == 400 and len(run(texts).collect()) == 400
        rows = spark.range(0, 8, 1, 4).mapInArrow(left, "models long, words long").collect()
        assert sum(r.models for r in rows) and not sum(r.words for r in rows)


def test_file_format():
    docs = [(1, np.arange(10, dtype=np.uint32)), (None, np.zeros(1, np.uint32)), (7, np.full(300, 50256, np.uint32)), (8, np.zeros(0, np.uint32))]
    sink = io.BytesIO()
    w = token_planes.Writer(sink, block=64, table_docs=2)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    source = pa.BufferReader(sink.getvalue())
    reader = token_planes.Reader(source)
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(d, x.tolist()) for d, x in docs]
    assert reader.block_ids(2).tolist() == np.concatenate([x for _, x in docs])[128:192].tolist()
    with pytest.raises(ValueError):
        token_planes.Writer(io.BytesIO()).add(1, np.array([1 << 16], np.uint32))
    with pytest.raises(ValueError):
        token_planes.Reader(pa.BufferReader(sink.getvalue()[:-3]))


def test_token_files(spark, sf_dir, duck):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_planes.public_vocabulary())
    texts = [*ODD, "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>  "] + [r[0] for r in duck.sql("SELECT text FROM documents LIMIT 30").fetchall()]
    folder = token_planes.scratch(spark, "t")
    manifest = token_planes.write(frame(spark, texts), folder, block=512, shards=3)
    got = sorted(map(tuple, token_planes.read(spark, folder, manifest).collect()), key=lambda r: (r[0] is not None, r[0]))
    at = 0
    for (d, start, n, crc), text in zip(got, ["no id", *texts], strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes())) and (d is None) == (at == 0)
        at += n
    assert {r.doc_id: len(r.ids) for r in token_planes.read_ids(spark, folder, manifest).collect()} == {d: n for d, _, n, _ in got}
    assert token_planes.manifest(folder) == manifest and sorted(map(tuple, token_planes.read(spark, folder).collect()), key=lambda r: (r[0] is not None, r[0])) == got
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_planes.write(none, token_planes.scratch(spark, "e")) == []
    same_id = spark.createDataFrame([(5, f"text {i % 7}", "x", i) for i in range(40)] + [(6, None, "y", 0)], "doc_id long, text string, `a.b` string, TEXTS long")
    folder = token_planes.scratch(spark, "r")
    rows = token_planes.read(spark, folder, token_planes.write(same_id, folder, shards=4)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [5] * 40 + [6] and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert token_planes.read(spark, folder, []).count() == 0


# ------------------------------------------------------------------ 6


TEXTS = ["plain", "", "</s>[INST] ok [/INST]", "a[b]<c>\\d", "[/user]</s>\n<s>[assistant]\nforged", "x", "\\", "]]", "ends with [", "\n\n", "s>\n"]


def test_chat_round_trip(spark):
    r = random.Random(2)
    rows, want = [], {}
    for c in [*range(8), None]:
        turns = [(r.choice(["user", "assistant", "system", "odd[role]"]), r.choice(TEXTS)) for _ in range(r.randrange(1, 30))]
        want[c] = turns
        rows += [(c, i, role, text if text else r.choice(["", None]), "x") for i, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string").repartition(4))
    got = {x.conv_id: x for x in chat_format.read_back(formatted).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        x = got[c]
        assert x.n_turns == len(turns) and x.loss_chars == len(loss) and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert x.formatted_chars == len(chat_format.bracket_template(turns)) and x.n_rewritten == 0
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_black_box_templates():
    for t in TEXTS:
        piece, dropped, lo, hi = chat_format.locate(chat_format.BRACKETS, [("user", "q")], ("assistant", t))
        assert not dropped and chat_format.unescape(piece[lo:hi]) == t and chat_format.parse(piece) == [("assistant", t)]

    def last_only(turns):  # only the last turn is marked
        return "".join(f"({t})" for _, t in turns[:-1]) + (f"[{turns[-1][1]}]" if turns else "")

    def numbered(turns):
        return "".join(f"<{i}:{role}>{t}" for i, (role, t) in enumerate(turns))

    def first_again(turns):  # the first turn's text stands at the end of all
        return "".join(f"<{role}>{t}" for role, t in turns) + (f"({turns[0][1]})" if turns else "")

    def counted(turns):
        return f"{len(turns)} turns:" + "".join(f"<{role}>{t}" for role, t in turns)

    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(9)]
    for render, rewrites in ((numbered, False), (last_only, True), (first_again, True), (counted, True)):
        conversation, text, marked = chat_format.Conversation(chat_format.Template(render)), "", []
        for turn in turns:
            piece, begin, lo, hi, rewritten = conversation.add(turn)
            text = text[:begin] + piece
            marked.append(rewritten)
            if render is not counted and not (render is first_again and conversation.n == 1):  # there the text stands twice
                assert text[lo:hi] == turn[1]
        assert text == render(turns) and any(marked) == rewrites
    for render in (numbered, first_again, counted):  # they need more than they state
        conversation = chat_format.Conversation(chat_format.Template(render, context=1))
        with pytest.raises(ValueError):
            for turn in turns:
                conversation.add(turn)
    long = chat_format.Conversation(chat_format.BRACKETS)
    for i in range(1100):
        assert not long.add(("user", f"t{i}"))[4]
    assert long.size == len(chat_format.bracket_template([("user", f"t{i}") for i in range(1100)]))


def test_op6_sql(spark, sf_dir, duck):
    assert same(chat_format.op6_chat_format(spark, sf_dir), duck.sql(chat_format.SQL)) > 1


# ------------------------------------------------------------------ 3


def test_extraction_cases():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Home</ul></nav>
    <div class="cookie-notice">Cookies</div><article><header><h1>Head &amp; line</h1><p>By me</header><p>One <b>two<br>three<p>Four&nbsp;  &lt;five&gt; &am 3 < 4
    <script>var t="</p>";</script><form>Search</form><aside>Side</aside><ul><li>a<li>b</ul><div class="comments"><p>First!</div></article><footer>&copy; x</footer></body></html><p"""
    assert main_text(page).split("\n") == ["Head & line", "One two three", "Four <five> &am 3 < 4", "a", "b"]
    assert html_extract.parse("") == [] and html_extract.parse("<p") == [] and html_extract.parse("<!-- open") == []


def main_text(page):
    blocks = html_extract.parse(page)
    level = html_extract.main_level(blocks)
    return "\n".join(t for k, hide, t in blocks if k >= level and not hide)


@pytest.mark.parametrize(("page", "text"), [
    ('<p>One <svg class="i"/> two</p><p>three</p>', "One two\nthree"),
    ("<p>One <noscript>two</p><p>three</p>", "One two\nthree"),
    ("<p>One</p><script>var x = 1 <p>two</p>", "One\ntwo"),
    ("<p>if a </ b then c</p>", "if a </ b then c"),
    ('<p title="a > b">x</p><p title=\'c > d\'>y</p>', "x\ny"),
    ('<p title="never closed>x</p>', "x"),
    ("<p don't>it's</p>", "it's"),
    ('<div class="content-sidebar-wrap"><main><p>kept</p></main><div class="sidebar">gone</div></div>', "kept"),
    ('<div class="my-sidebar"><main><p>kept</p></main></div>', "kept"),
    ('<article><p class="share-price">12.5</p><p class="share-buttons">Share</p><div class="ad">Buy</div></article>', "12.5"),
    ("<main>lead<article>card</article></main>", "lead\ncard"),
    ('<div class="comments"><article><p>only this</p></article></div>', "only this"),
    ('<article><p>text</p></article><div class="comments"><article><p>reader</p></article></div>', "text"),
    ('<article class="comment-free post"><p>text</p></article>', "text"),
    ('<article><p>a</p><div class="post-comments"><p>reader</p></div><div class="sponsored-content">ad</div></article>', "a"),
])
def test_markup(page, text):
    assert main_text(page) == text


def test_suffix_runs_equal_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        size = r.integers(0, 40, 6)
        tokens, page = r.integers(0, 4, size.sum()).astype(np.int64), np.repeat(np.arange(6), size)
        n = html_extract.RUN
        at = [i for i in range(len(tokens) - n + 1) if page[i] == page[i + n - 1]]
        where = {}
        for i in at:
            where.setdefault(tuple(tokens[i : i + n]), set()).add(page[i])
        twice, once = html_extract.repeated(tokens, page)
        assert twice.tolist() == [i for i in at if len(where[tuple(tokens[i : i + n])]) > 1]
        assert once.tolist() == [i for i in at if len(where[tuple(tokens[i : i + n])]) == 1]


def test_pages_without_container(spark):
    menu = "<div>Home News About Contact Imprint Search</div>"
    rows = [(i, f"https://Host.example/{i}", f"<body>{menu}<p>{' '.join(f'w{i}x{j}' for j in range(20))}</p></body>", "x") for i in range(30)]
    rows += [(90, None, None, "x"), (91, "https://other.example/", "<p>Alone on its host here and now</p>", "x"), (92, "https://host.example/copy", rows[3][2], "x"), (93, "nonsense", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for part_tokens in (10**6, 60):  # one part, and parts that have to be compared with each other
        got = {r.page_id: r for r in html_extract.extract(pages, part_tokens).collect()}
        for i in range(30):
            assert got[i].text.endswith(f"w{i}x18 w{i}x19") and ("Home" in got[i].text) == (i == 3), got[i]
        assert (got[90].text, got[90].n_chars, got[93].text) == ("", 0, "") and got[91].text == "Alone on its host here and now"
        assert "Home" in got[92].text  # a page that repeats as a whole is a copy
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_large_host_keeps_phrases(spark):
    """Phrases that a few pages of a large host share stay; blocks on many of its pages go, however little else there is."""
    menu, notice = "<div>Home News About Contact Imprint Search</div>", "<div>This site stores small files on your device</div>"
    rows = []
    for i in range(120):
        own = [f"w{i}x{j}" for j in range(12)]
        text = " ".join([*own[:6], f"phrase{i % 60} of just six words here", *own[6:]])
        rows.append((i, "https://large.example/", f"<body>{menu}{notice}<p>{text}</p></body>"))
    rows += [(500 + i, "https://large.example/", f"<body>{menu}{notice}<p>short{i} text</p></body>") for i in range(3)]
    want = {i: page.split("<p>")[1].split("</p>")[0] for i, _, page in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part_tokens in (10**6, 300):
        assert {r.page_id: r.text for r in html_extract.extract(pages, part_tokens).collect()} == want


def test_furniture_inside_articles(spark):
    """What stands as furniture outside containers goes inside articles too; what articles share, or menus quote, stays."""
    menu, notice = ("Home", "News", "About", "Contact", "Imprint", "Search", "Help"), "This site stores small files on your device today"
    lead, quote = "The mayor has opened a bridge over the river", "Whoever quotes this sentence of seven words gains"
    items = "<ul>" + "".join(f"<li>{x}" for x in menu) + "</ul>"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(9))
    rows, want = [], {}

    def page(i, url, body, blocks):
        rows.append((i, url, f"<body>{body}</body>"))
        want[i] = "\n".join(blocks)

    for i in range(24):  # furniture stands in its place, and the menus name an article
        quoted = [quote] if i % 2 else []
        body = "".join(f"<p>{x}</p>" for x in [own(i), *quoted, f"short {i}"])
        page(i, "https://host.example/", f"<nav>{items}</nav><article>{body}</article><aside>{lead}</aside><footer>{notice}</footer>", [own(i), *quoted, f"short {i}"])
    for i in range(24, 36):  # another layout has it in the article, list items of one word each among it; some articles are copies
        k = 24 + i % 4
        page(i, "https://host.example/", f"<article>{items}<h1>Head {k}</h1><p>{own(k)}</p><p>{notice}</p></article>", [f"Head {k}", own(k)])
    for i in range(36, 54):  # near copies of the article that the menus name
        rest = f"A long report of what came to pass there{' indeed' * (i - 35)}"
        page(i, "https://host.example/", f"<div class='post'><p>{lead}</p><p>{rest}</p><p>The end of it is as it was before</p></div>", [lead, rest, "The end of it is as it was before"])
    page(60, "https://other.example/", f"<article><p>{notice}</p></article>", [notice])  # another host
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part_tokens in (10**6, 100):
        got = {r.page_id: r for r in html_extract.extract(pages, part_tokens).collect()}
        assert {i: r.text for i, r in got.items()} == want
        assert got[30].boilerplate_tokens == len(menu) + len(notice.split()) and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.without_furniture(own(1), [], np.zeros(0, np.int64)) == (own(1), 0)


def test_articles(spark, sf_dir):
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_extract.op3_html_extract(spark, sf_dir).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# ------------------------------------------------------------------ 1, 9


def test_quality_gradients():
    net = quality.Network.fresh(1)
    data = np.random.default_rng(0).integers(32, 120, 900).astype(np.uint8)
    x, text = quality.chunks(data, np.array([0, 0, 500, 900]))
    assert text.tolist() == [0, 1, 1, 1, 2, 2]
    net.embed, net.conv = net.embed.astype(np.float64), net.conv.astype(np.float64)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z, held = quality.forward(net, net.responses(), x, text, 3)
        return float(np.log1p(np.exp(-(2 * y - 1) * z)).sum()), 1 / (1 + np.exp(-z)) - y, held

    _, d, held = loss()
    for p, g in zip(net.parameters(), quality._gradients(net, x, text, d, held), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[i], 1e-3
        p[i] = old + e
        up = loss()[0]
        p[i] = old - e
        down = loss()[0]
        p[i] = old
        assert np.isclose((up - down) / (2 * e), g[i], rtol=0.08, atol=1e-3)


def test_quality_learns_and_covers_the_end(spark):
    r = random.Random(4)
    good = lambda: " ".join("".join(r.choices("etaoinshr", k=5)) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join("".join(r.choices("ETAOINSHR", k=5)) + "!!" for _ in range(60))
    texts = [good() if i % 2 else bad() for i in range(120)]
    net = quality.fit([t.encode() for t in texts[:100]], [i % 2 for i in range(100)])
    rows = [*texts[100:], "", None, good() * 30 + bad() * 4]
    got = {x.doc_id: x.score for x in quality.score(frame(spark, rows), net).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(20))
    assert all(0 <= v <= 1 for v in got.values()) and got[20] == got[21]
    assert got[22] != pytest.approx(quality.predict(net, np.frombuffer((good() * 30).encode(), np.uint8), np.array([0, len((good() * 30).encode())]))[0], abs=1e-6)
    assert not quality.fit([b"a"], [1]).trained and quality.predict(quality.fit([], []), np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [0.5]


def brute_evidence(text, words, stems):
    """Clauses read by plain rules instead of the machine."""
    import re

    T, total = toxicity, 0.0
    for clause in re.split(r"[.!?;\n]+", text.lower()):
        w = re.findall(r"[\w'’]+", clause)
        weight = {i: words.get(x) or next((stems[x[:n]] for n in range(8, 3, -1) if x[:n] in stems and len(x) >= n), None) for i, x in enumerate(w)}
        insults = [i for i in weight if weight[i]]
        cue = lambda names: [i for i, x in enumerate(w) if x in names and i not in insults]  # noqa: B023, E731
        harms, objects = cue(T.THREATS), cue(T.OBJECTS)
        denied = any(n < min(insults + harms, default=-1) for n in cue(T.NEGATIONS))
        by = (T.NEGATED if denied else 1) * (T.REPORTED if cue(T.REPORTS) else 1)
        total += by * sum(weight[i] for i in insults) * (T.AIMED if objects or cue(T.SUBJECTS) else 1)
        total += by * (T.THREAT_WEIGHT * (1 if cue(T.INTENTS) else T.WITHOUT_INTENT) if harms and objects else 0)
    return total


def test_toxicity_grammar(spark):
    T = toxicity
    g = T.Grammar({"idiot": 2.0}, {"lowei": 1.0}, slope=2.0, length=0.5, bias=-3.0, constant=False)
    count = lambda t: T.evidence(t, g, {})[0]
    assert [count(t) for t in ("An idiot.", "You idiot", "idiot, you", "nothing", "to kill time", "time will kill", "you. idiot", "loweischaft and loweient")] == [2, 3, 3, 0, 0, 0, 2, 2]
    assert count("I will kill you") == T.THREAT_WEIGHT and count("kill him") == T.THREAT_WEIGHT * T.WITHOUT_INTENT
    assert count("Not an idiot") == pytest.approx(2 * T.NEGATED) and count("an idiot, not") == 2 and count("they said an idiot") == 3 * T.REPORTED
    r = random.Random(8)
    every = ["idiot", "loweix", "x", "yy", ".", "\n", *T.THREATS[:2], *T.OBJECTS[:2], *T.SUBJECTS[:2], *T.INTENTS[:2], *T.NEGATIONS[:2], *T.REPORTS[:2]]
    for _ in range(3000):
        text = " ".join(r.choices(every, k=r.randrange(14)))
        e = brute_evidence(text, g.words, g.stems)
        assert T.evidence(text, g, {})[0] == pytest.approx(e)
        ends = len([x for x in __import__("re").findall(r"[.!?;\n]+", text)])
        assert T.text_score(text, g, {}) == pytest.approx(1 / (1 + np.exp(3 - 2 * np.log1p(e) + 0.5 * np.log1p(ends))))


def test_toxicity_learns(spark):
    T, r = toxicity, random.Random(6)
    plain = lambda: " ".join(r.choices([f"w{i}" for i in range(300)], k=30))
    texts = [plain() + (" idiot lowei" + r.choice("abcdefghi") + r.choice("xyz") if i % 4 == 0 else "") for i in range(400)]
    g = T.fit(texts, [int(i % 4 == 0) for i in range(400)])
    assert g.symbol("idiot")[0] == T.INSULT and g.slope > 0 and g.length >= 0
    score = lambda t: T.text_score(t, g, {})
    assert score("You are an idiot.") > score("An idiot.") > score("He said an idiot.") > score("Not an idiot.") > score("")
    assert score("I will kill you") > 0.5 > score("to kill time")
    rows = [plain() + " idiot", plain(), "", None, "IDIOT!", plain() * 500 + " idiot"]
    got = {x.doc_id: x.score for x in T.score(frame(spark, rows), g).collect()}
    assert got[0] > 0.5 > got[1] and got[2] == got[3] < 0.5 and got[4] > 0.5 and got[5] > 0.5
    assert T.fit(["a"], [0]).constant and T.fit([], []).constant
    assert T.score(spark.createDataFrame([], "doc_id long, text string"), g).count() == 0


def test_sample(spark):
    from pagelore.llm._labels import labelled_sample

    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(200)] + [(60, "x" * 500), (None, "no id"), (61, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(62)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    texts, ys = labelled_sample(docs, labels, "toxic", 5, 9, 1000, 20_000)
    assert len(texts) == 201 and "x" * 500 not in texts and texts.count("") == 1
    assert sum(ys) == 101 and labelled_sample(docs, labels, "toxic", 5, 9, 1000, 20_000) == (texts, ys)
    assert len(labelled_sample(docs, labels, "toxic", 5, 9, 10, 20_000)[0]) == 10  # rows, not labels
    assert sum(map(len, labelled_sample(docs, labels, "toxic", 5, 9, 1000, 900)[0])) <= 900
    with pytest.raises(ValueError):
        labelled_sample(docs, labels, "toxic", 5, 9, 1, 20_000)
    assert labelled_sample(docs.limit(0), labels.limit(0), "toxic", 5, 0, 10, 100) == ([], [])


def test_quality_score_by_a_plain_loop():
    """One text's score from the definition, filter by filter."""
    Q, net = quality, quality.Network.fresh(3)
    for text in (b"", b"short", bytes(range(32, 127)) * 9):
        padded = list(text) + [Q.PAD] * Q.CHUNK
        features = []
        for k in range(max(1, 1 + -(-(len(text) - Q.CHUNK) // Q.STRIDE))):
            part = [b if k * Q.STRIDE + i < len(text) else Q.PAD for i, b in enumerate(padded[k * Q.STRIDE : k * Q.STRIDE + Q.CHUNK])]
            z = [[max(0.0, sum(float(net.embed[part[i + w]] @ net.conv[w][:, f]) for w in range(Q.WIDTH)) + float(net.conv_b[f])) for f in range(Q.FILTERS)] for i in range(Q.CHUNK - Q.WIDTH + 1)]
            pooled = [max(c) for c in zip(*z)] + [sum(c) / len(z) for c in zip(*z)]
            features.append(np.maximum(np.array(pooled) @ net.hidden + net.hidden_b, 0))
        both = np.concatenate([np.max(features, 0), np.mean(features, 0)])
        want = 1 / (1 + np.exp(-(both @ net.out + net.out_b[0])))
        assert Q.predict(net, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] == pytest.approx(float(want), abs=1e-5)


def test_labels_of_the_held_out_fold_are_never_read(spark):
    rows = [(i, f"text {i} {'idiot' if i % 2 else 'fine'}", i % 2, i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for module, column, fold, held in ((toxicity, "toxic", 5, 0), (quality, "quality", 4, 2)):
        labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows], "doc_id long, quality int, toxic int")
        secret = F.expr(f"pmod(crc32(cast(doc_id as string)), {fold}) = {held}")
        flipped = labels.withColumn(column, F.when(secret, 1 - F.col(column)).otherwise(F.col(column)))
        a, b = module.train(docs, labels), module.train(docs, flipped)
        if module is toxicity:
            assert (a.words, a.stems, a.slope, a.length, a.bias) == (b.words, b.stems, b.slope, b.length, b.bias)
        else:
            assert all(np.allclose(x, y) for x, y in zip(a.parameters(), b.parameters(), strict=True))
