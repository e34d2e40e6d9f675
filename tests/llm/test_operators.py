"""Each operator on small tables: defined cases, and brute force where SQL has no form."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litsieve.llm import chat_format, common, decontaminate, exact_dedup, html_extract, jaccard_join, linking, packing, queries, substring_dedup, token_files, toxicity, url_filter
from litsieve.llm.shingles import shingles, word_hashes

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, sig binary, score double"


def prose(seed, n):
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)]
    for i in range(9, n, 10):
        out[i] += "."
    return " ".join(out)


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", b"x", 0.5) for i, t in zip(ids, texts, strict=True)], DOCS)


def test_best_fit_packing(spark):
    texts = [None, "", prose(1, 40) + "<|endoftext|>x", prose(2, 3000), *(prose(i, 10 + 37 * i % 400) for i in range(60)), prose(2, 3000)]
    made = packing.tokenize_pieces(docs(spark, texts, ids=[7, 7, *range(10, 10 + len(texts) - 2)]), queries.tokenizer_path("byte_bpe_50k.json"))
    pieces = made.toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for t in texts)
    rows = pieces.sort_values(["doc_id", "piece"])
    assert sum(rows.length) == sum(map(len, want)) and rows.length.max() <= 2048
    got = {}
    for r in rows.itertuples():
        if r.doc_id != 7:
            got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert sorted(map(tuple, got.values())) == [w for w in want if w != (0,)]
    placed = packing.pack(made.drop("ids"), group_items=25).toPandas()  # several groups, so several rounds
    assert len(placed) == len(pieces)
    for _, g in placed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]] and g.length.sum() <= 2048
    assert placed.sequence_id.nunique() <= -(-placed.length.sum() // 2048) + 1
    assert packing.sequences(made, packing.pack(made.drop("ids"))).count() <= placed.sequence_id.nunique()
    assert packing.pack(packing.tokenize_pieces(docs(spark, [])[["doc_id", "text"]], queries.tokenizer_path("byte_bpe_50k.json")).drop("ids")).count() == 0


def test_packing_against_the_optimum(spark):
    """Small sets: never more than one sequence above the least number that brute force finds."""
    def least(sizes, bins):
        if not sizes:
            return len(bins)
        tried, out = set(), len(bins) + len(sizes)
        for i, b in enumerate(bins):
            if b + sizes[0] <= 20 and b not in tried:
                tried.add(b)
                out = min(out, least(sizes[1:], [*bins[:i], b + sizes[0], *bins[i + 1 :]]))
        return min(out, least(sizes[1:], [*bins, sizes[0]]))

    rng, above = random.Random(2), 0
    for _ in range(40):
        sizes = sorted((rng.randrange(2, 13) for _ in range(9)), reverse=True)
        got = len(packing.improve(packing.best_fit(sizes, 20), 20))
        above += got - least(sizes, [])
        assert got <= least(sizes, []) + 1
    assert above <= 2
    odd = spark.range(30).selectExpr("id as row_id", "id % 7 + 1L as length", "1 as g", "2 as fill", "'s' as sequence_id", "3 as level")
    placed = packing.pack(odd, capacity=10)
    assert placed.columns == ["row_id", "length", "g", "fill", "level", "sequence_id", "offset"] and placed.where("fill = 2 and g = 1").count() == 30


def test_packing_groups_stay_bounded(spark):
    items = spark.range(3000).selectExpr("id as row_id", "1000L as length")
    placed = packing.pack(items, group_items=300).toPandas()
    assert len(placed) == placed.row_id.nunique() == 3000 and placed.groupby("sequence_id").length.sum().max() <= 2048
    assert placed.groupby(placed.sequence_id // 2**20).size().max() <= 450  # pieces one task packed in the last round
    assert placed.sequence_id.nunique() <= 1500 + 10  # one odd piece a group at most


def test_local_search_moves_and_swaps():
    full = packing.improve([[(6, 0), (3, 1)], [(7, 2), (2, 3)], [(1, 4), (1, 5)]], 10)
    assert sorted(sum(x[0] for x in b) for b in full) == [10, 10]
    swapped = packing.improve([[(5, 0), (3, 1)], [(4, 2), (4, 3), (1, 4)], [(4, 5)]], 10)
    assert sum(sum(x[0] for x in b) ** 2 for b in swapped) > 8**2 + 9**2 + 4**2
    assert sorted(i for b in swapped for _, i in b) == list(range(6))


def test_simple_8b_round_trips():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.zeros(500), rng.integers(0, 49408, 5000), np.where(rng.random(3000) < 0.01, 2**62, rng.integers(0, 8, 3000)), np.array([2**64 - 1], dtype=np.uint64)):
        ids = ids.astype(np.uint64)
        words, places, values = token_files.encode_block(ids)
        assert np.array_equal(token_files.decode_block(words, len(ids), places, values), ids)
    assert len(token_files.encode_block(np.zeros(6000))[0]) == 100


def test_token_files(spark):
    texts = [None, "", "a  b\t c", "Hello WORLD", "x<|endoftext|> y", prose(3, 2000), *(prose(i, 200) for i in range(30))]
    manifest = token_files.write_token_files(docs(spark, texts, ids=list(range(len(texts)))[::-1]), queries.tokenizer_path("word_bpe_49k.json"), file_ids=3000)
    got = token_files.read_token_files(manifest).toPandas().sort_values("doc_id")
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), 0
    for r, t in zip(got.itertuples(), texts[::-1], strict=True):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    tied = docs(spark, ["b", "a b c", "a", "a", None], ids=[3, 3, 3, None, None])
    got = token_files.read_token_files(token_files.write_token_files(tied, queries.tokenizer_path("word_bpe_49k.json"))).toPandas().sort_values("start")
    assert got.doc_id.isna().tolist() == [True, True, False, False, False]
    assert got.start.tolist() == np.cumsum([0, *got.n_tokens.tolist()[:-1]]).tolist()
    order = sorted(["b", "a b c", "a"], key=lambda t: zlib.crc32(t.encode()))
    assert got.n_tokens.tolist()[2:] == [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in order]
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), queries.tokenizer_path("word_bpe_49k.json"))).count() == 0


def test_html_extract(spark):
    page = "<html><head><title>x</title></head><body><nav><a href='/'>home</a></nav><div class='post-{0}'><h1>T &amp; U</h1><p>one  two<br>three<div class='ad'>buy</div><p>fo<b>ur</b></div><aside>no</aside><div id='comments'>me too</div><footer>f</footer></body>"
    rows = [(i, f"http://a.b/{i}", page.format(i), "x") for i in range(6)] + [(6, None, None, "x"), (7, "http://c.d/", "", "x"), (8, "http://c.d/", "<p>plain &lt;b&gt;", "x"), (8, "http://c.d/", "<p>plain &lt;b&gt;", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for most in (100, 0):  # the table of paths, and the salted join
        got = sorted((r["page_id"], r["text"]) for r in html_extract.main_text(pages, most_hosts=most).collect())
        assert got == [(i, "T & U one two three four") for i in range(6)] + [(6, ""), (7, ""), (8, "plain <b>"), (8, "plain <b>")]
    assert html_extract.main_text(pages.where("false")).count() == 0


def test_html_names_are_no_veto(spark):
    """Names only make an element suspect; the page's and the host's text decides."""
    assert html_extract.extract('<div class="main has-sidebar"><p>article text here</div><footer>foot</footer>') == "article text here"
    assert html_extract.extract('<div class="overflow-hidden"><p>article</div>') == "article"
    assert html_extract.extract('<div class="social"><p>a whole article about it</div>') == "a whole article about it"
    assert html_extract.extract('<p>the article is this one here<div class="ad">buy</div><div hidden>no</div><div style="display: none">no</div><div data-hidden="x">yes</div>') == "the article is this one here yes"
    page = "<body><div class='c{0}'><p>{1}</p><div class='zz'>same on all pages of this host</div></div><div class='comments'>{2}</div></body>"
    rows = [(i, f"http://h.net/{i}", page.format(i, prose(i, 30), prose(100 + i, 20))) for i in range(7)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: prose(i, 30) for i in range(7)}


def test_html_shapes_that_hide_articles(spark):
    """Pages wrapped in one form, open anchors, articles inside a link, comments under any name; each on a host of its own."""
    article = lambda i: "".join(f"<p>{prose(i * 10 + j, 40)}</p>" for j in range(3))
    text = lambda i: " ".join(prose(i * 10 + j, 40) for j in range(3))
    said = lambda i, n: "".join(f"<div class='b-{k}'><span>Ann</span> <i>{k + 1} May 2021</i><p>{prose(5000 + i * 10 + k, 15)}</p></div>" for k in range(n))
    items = lambda i, n: "".join(f"<li>Bob, 2021-05-0{k + 1}<p>{prose(7000 + i * 10 + k, 15)}" for k in range(n))
    shapes = {
        "form.net": lambda i: f"<body><form action='x'><div class='c'>{article(i)}</div><label>Name</label><input><select><option>a</select></form></body>",
        "anchor.net": lambda i: f"<body><a name='top'><div class='c'>{article(i)}</div><div class='box'>boxed text {i}</div></body>",
        "open.net": lambda i: f"<body><a href='/'>home<div class='c'>{article(i)}</div><div class='box'>boxed <a href='/b'>text</a> {i}</div></body>",
        "link.net": lambda i: f"<body><a href='/x'><div class='c'>{article(i)}</div></a></body>",
        "replies.net": lambda i: f"<body><div class='c'>{article(i)}</div><div class='replies'><h3>{i} replies</h3>{said(i, i % 4)}</div></body>",
        "inner.net": lambda i: f"<body><div class='c'>{article(i)}<ol class='thread'>{items(i, i % 4)}</ol></div></body>",
        "signup.net": lambda i: f"<body><div class='c'>{article(i)}</div><form><p>Your {i} mails a week</p><input></form></body>",
        "list.net": lambda i: f"<body><div class='c'>{article(i)}<ul><li>{prose(i, 9)}<li><p>{prose(i + 1, 9)}</ul></div></body>",
        "notes.net": lambda i: f"<body><div class='c'>{article(i)}<section><h2>Two 2021-05-02</h2><p>new {i}</p></section><section><h2>One 2021-05-01</h2><p>old {i}</p></section></div></body>",
    }
    tails = {"list.net": lambda i: f" {prose(i, 9)} {prose(i + 1, 9)}", "notes.net": lambda i: f" Two 2021-05-02 new {i} One 2021-05-01 old {i}"}
    rows = [(n * 100 + i, f"http://{h}/{i}", make(i)) for n, (h, make) in enumerate(shapes.items()) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n, h in enumerate(shapes):
        for i in range(8):
            assert got[n * 100 + i] == text(i) + tails.get(h, lambda i: "")(i), (h, i)


def test_html_deep_and_long_pages():
    import time

    began = time.time()
    deep = "<div>" * 5000 + "<p>low" + "</div>" * 5000 + "<p>x"
    assert html_extract.extract(deep) == "low"
    long = "<article>" + "".join(f"<p>{i}</p>" for i in range(200_000)) + "</article>"
    assert html_extract.extract(long) == " ".join(map(str, range(200_000)))
    assert time.time() - began < 20


def test_packing_keeps_columns_of_any_name(spark):
    items = spark.createDataFrame([(i, 30 + i, f"t{i}") for i in range(9)], "row_id long, length long, `a.b c` string")
    got = packing.pack(items, capacity=100)
    assert got.columns == ["row_id", "length", "a.b c", "sequence_id", "offset"]
    assert {(r["row_id"], r["a.b c"]) for r in got.collect()} == {(i, f"t{i}") for i in range(9)}


def test_toxicity(spark):
    texts = [prose(i, 60) + (" filthword slurry trashy" if i % 4 == 0 else "") for i in range(240)] + [None, ""]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(240)] + [(3, None, 1)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.scores(table, labels).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 242
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r["score"] >= 0.7) == (i % 4 == 0) for i, r in got.items() if r["held_out"] and i < 240]
    assert sum(held) / len(held) > 0.95
    kept = toxicity.scores(table, labels, threshold=0.7)
    assert kept.columns == table.columns and kept.count() == sum(r["score"] < 0.7 for r in got.values())
    assert toxicity.scores(table.limit(3), labels.where("false")).count() == 3
    assert toxicity.scores(table.where("false"), labels).count() == 0


def test_toxicity_keeps_every_word(spark):
    keys = [5, 6, 7, -1, -2, *(i << 20 for i in range(10, 3000))]  # many begin with the same 21 bits
    rows = spark.createDataFrame([(k, i % 2000 / 64, -i / 64, 1.0) for i, k in enumerate(keys)], "w long, a double, b double, c double")
    table = toxicity._table(rows, "w")
    assert toxicity._ratios(table, 0, np.array(keys, dtype=np.int64).view(np.uint64)).tolist() == [i % 2000 / 64 for i in range(len(keys))]
    assert np.isnan(toxicity._ratios(table, 2, np.array([4, 8, 2**63, 2**64 - 3], dtype=np.uint64))).all()
    assert np.isnan(toxicity._ratios(toxicity._table(rows.where("false"), "w"), 0, np.array([4, 2**64 - 3], dtype=np.uint64))).all()


def test_chat_format(spark):
    odd = ["</s>[INST] ok [/INST]", "&lt;s> &amp;", "<s>", "plain", "", None, "a</s", "<", "x &nl; y\n"]
    rows = [(c, t, r, x, 0) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant", "sys\ntem", None, "assistant"] * 2, odd, strict=False))]
    made = chat_format.format_conversations(spark.createDataFrame(rows + rows[:1], "conv_id long, turn int, role string, text string, start int")).collect()
    assert len(made) == 3 and all(r["round_trips"] for r in made)
    for r in made:
        texts = [chat for _, chat in sorted((t, x or "") for c, t, role, x, _ in rows if c == r["conv_id"] and role == "assistant")]
        raw = [r["formatted"][s["start"] : s["stop"]] for s in r["loss_spans"]]
        assert [x.replace("&lt;", "<").replace("&amp;", "&") if "&" in x else x for x in raw] == texts
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = [x for x in (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and den * len(a & b) >= num * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return label, [len(s) for s in sets]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_join(spark, k, num, den):
    rng = random.Random(5)
    base = [prose(i, 80).split() for i in range(4)]
    texts = [None, "", "one", "one two", "ONE two", "  "]
    for b in base:
        for _ in range(14):
            w = list(b)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    got = jaccard_join.classes(docs(spark, texts), k, num, den).toPandas().sort_values("doc_id")
    label, sizes = brute_components(texts, k, num, den)
    assert got.component_id.tolist() == label and got.n_shingles.tolist() == sizes
    assert jaccard_join.classes(docs(spark, [])).count() == 0


def test_word_hashes():
    h, text, a, b = word_hashes(["A bé\x0b c", None, "a"])
    assert text.tolist() == [0, 0, 0, 2] and h[0] == h[3] and list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (2, 5), (7, 8), (0, 1)]
    assert len(shingles(h, text, 3, 3)[0]) == 2


def test_group_bound_is_lossless(spark):
    """A set of 100 and one of 109 that share 99 (0.9 exactly) share no more than the 4 keys every pair needs; a group of sizes 100 to 110 must still be opened."""
    dealt = [(1, 100, 4, 1, 0, 10), (2, 109, 4, 2, 0, 20), (3, 110, 4, 3, 0, 20), (4, 100, 4, 4, 0, 20)]
    dealt = spark.createDataFrame(dealt, "id long, n long, need int, label long, band long, g long")
    held = spark.createDataFrame([(k, i) for k in range(4) for i in (1, 2)], "key long, id long")
    assert (10, 20) in {(min(r["x"], r["y"]), max(r["x"], r["y"])) for r in linking.meetings(held, dealt, 90, 100, True).collect()}


def test_group_task_finds_what_is_alike():
    """Overlaps by matrix equal those by sets; links span the components and no more."""
    rng = np.random.default_rng(4)
    base = np.arange(60)
    side = lambda n, at: [(at + i, at + i, np.unique(np.where(rng.random(60) < 0.06, rng.integers(1000, 9000, 60), base))) for i in range(n)]
    left, right = side(30, 0), side(25, 100)
    got = linking._overlaps([s for *_, s in left], [s for *_, s in right])
    assert got.tolist() == [[len(set(a) & set(b)) for *_, b in right] for *_, a in left]
    links = linking._matched(left, right, 90, 100)
    assert len(links) < len(left) + len(right)
    joined = {frozenset((a, b)) for a, _, x in left for b, _, y in right if 100 * len(set(x) & set(y)) >= 90 * len(set(x) | set(y))}
    top = {i: i for i, *_ in left + right}
    for pairs in (joined, links):
        label = dict(top)
        for _ in top:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        top_of = label if pairs is joined else top_of  # noqa: F821
        assert label == top_of


def test_keys_of_far_sizes_are_dropped(spark, monkeypatch):
    """Keys that only sets of far sizes share make no rows; those of near sizes stay, over the edge of a band too."""
    far = [(k, i, 20 + 10 * i * i, 6) for i in range(12) for k in range(8)]
    near = [(k, 100 + i, n, 6) for i, n in enumerate((1000, 1080)) for k in range(50, 58)]
    seen = []
    monkeypatch.setattr(linking, "_star_links", lambda held, *_: seen.append(held) or spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(linking, "_group_links", lambda held, sets_of, stars, *_: seen.append({r.id for r in held.collect()}) or stars)
    linking.link(spark.createDataFrame(far + near, "key long, id long, n long, need int"), None, 90, 100, True).count()
    assert seen[1] == {100, 101}


def test_bands_of_near_sizes_meet(spark):
    rows = spark.range(1, 3000).selectExpr("id as n").withColumn("m", F.floor(F.col("n") * 10 / 9))
    far = rows.withColumns({"x": linking._band("n", 90, 100), "y": linking._band("m", 90, 100)}).where("y - x not in (0, 1)")
    assert far.count() == 0


def test_slices_give_memory_back():
    pages = lambda: int(open("/proc/self/statm").read().split()[1])
    held = [bytes(600) for _ in range(300_000)]
    last = bytes(600)  # lies above them, so that they don't go by themselves
    del held
    full = pages()
    list(common.slices(pa.record_batch([pa.array(["x"])], names=["text"]), "text"))
    assert last is not None and pages() < full - 20_000


def test_jaccard_join_large_group_unlinked(spark):
    """Most copies of one text differ too much from each other to be linked, but share keys; only the planted pairs link."""
    lines = template_lines(150)
    got = jaccard_join.classes(docs(spark, lines), 5, 80, 100).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == [i - i % 2 for i in range(len(lines))]
    label, sizes = brute_components(lines[:60], 5, 80, 100)
    assert got.component_id.tolist()[:60] == label and got.n_shingles.tolist()[:60] == sizes


def test_jaccard_join_repeated_and_null_ids(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    near = b.replace(b.split()[0], "other", 1)
    got = jaccard_join.classes(docs(spark, [a, b, a, near, c, c, None], ids=[1, 5, 5, 9, None, 7, None]), 3, 80, 100).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(1, 1), (5, 5), (5, 1), (9, 5), (None, 7), (7, 7), (None, None)], key=str)


def test_components(spark):
    from litsieve.llm.components import components

    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 330)] + [(329, 100), (5, 5), (900, 901)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([7, *range(100, 161), *range(300, 330)], 7), 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    texts = ["x", None, "", "y", "x", "x", "y ", prose(1, 5000)]
    got = {r["doc_id"]: r for r in exact_dedup.classes(docs(spark, texts)).collect()}
    assert [got[i]["keep_id"] for i in range(8)] == [5, 2, 2, 3, 5, 5, 6, 7]
    assert [got[i]["group_size"] for i in range(8)] == [3, 2, 2, 1, 3, 3, 1, 1]
    assert [i for i in range(8) if got[i]["kept"]] == [2, 3, 5, 6, 7] and got[0]["text_sha256"] == hashlib.sha256(b"x").hexdigest()
    assert exact_dedup.classes(docs(spark, ["a", "a"], ids=[1, 1])).where("kept and group_size = 2").count() == 2
    assert exact_dedup.classes(docs(spark, [])).count() == 0


def test_cuckoo_index(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = lambda a, b: spark.createDataFrame([(digest(i), i, 1) for i in range(a, b)], "digest string, keep_id long, group_size long")
    index = exact_dedup.fresh_index(rows(0, 300), 3)
    index = exact_dedup.insert(index, rows(200, 4000), 3)  # known ones are summed, and the filters grow from the stored keys
    assert index.where("digest is not null").count() == 4000 and index.where("group_size = 2").count() == 100
    index = exact_dedup.delete(index, rows(0, 1000).unionByName(rows(9000, 9100)), 3)
    found = {r["digest"]: r["live"] for r in exact_dedup.lookup(index, rows(0, 4200), 3).collect()}
    assert all(found[digest(i)] == (1000 <= i < 4000) for i in range(4200))
    filled = exact_dedup.CuckooFilter(8)
    assert not filled.insert(np.arange(1, 100, dtype=np.uint64))


def test_url_filter(spark):
    urls = {"http://a.org/x": ("org/", "allow"), "https://EXAMPLE.org/es/1": ("example.org/es/", "block"), "x://q.example.org/en/17?y": ("example.org/en/1", "block"), "http://example.org": (None, "allow"), "http://m.casino-win.example.net/en/1": (None, "block"), "http://occasino.net/": (None, "allow"), "http://b.com/fr/": ("com/fr/", "allow"), "http://b.com/de/?q": ("com/de/", "block"), "nope": (None, "allow"), None: (None, "allow"), "http://notexample.org/es/": ("org/", "allow")}
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, "http://a.org/x", "h")], "page_id long, url string, host string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.judge(pages).orderBy("page_id").collect()]
    assert got == [("org/", "allow"), *urls.values()]
    more = [url_filter.site_rule("block", f"h{i}.example.net", f"/p{i}/") for i in range(700)]  # beyond the inline list
    wide = pages.union(spark.createDataFrame([(99, "http://x.h699.example.net/p699/?a", "h")], pages.schema))
    rules = url_filter.SITE_RULES + url_filter.WORD_RULES + more
    tables = [sorted(map(str, url_filter.judge(wide, rules, inline=n).collect())) for n in (500, 10_000)]
    assert tables[0] == tables[1] and any("h699.example.net/p699/" in r for r in tables[0])
    assert url_filter.judge(pages.where("false")).count() == 0


def test_exact_dedup_filter_gates_lookups():
    """Stored content is read for hits only; misses go in without a lookup, and a full filter grows from the stored keys."""
    import pandas as pd

    digest = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    frame = lambda d, ids: pd.DataFrame({"digest": d, "keep_id": pd.array(ids, dtype="Int64"), "group_size": 1})
    held = exact_dedup.Bucket(pd.DataFrame({"digest": [], "keep_id": [], "group_size": [], "slots": []}))
    held.insert(frame(digest, range(3000)))
    assert len(held.live) == 3000 and held.verified < 30  # false positives of the filter only
    before = held.verified
    held.insert(frame(digest[:500] * 2, [None] * 500 + list(range(9000, 9500))))
    assert held.verified - before == 500 * 2 and held.live[digest[7]] == (9007, 3)
    held.filled.contains = lambda keys: np.zeros(len(keys), dtype=bool)  # were the filter bypassed, this would change nothing
    held.insert(frame(digest[:1], [1]))
    assert held.live[digest[0]] == (1, 1)


def test_exact_dedup_hot_text(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end as text", "'x' as digest")
    got = exact_dedup.classes(rows, salts=2)
    assert got.count() == 5000 and got.where("kept").count() == 3334 and got.where("keep_id = 4998 and group_size = 1667").count() == 1667


def test_substring_dedup(spark):
    passage = prose(99, 60)
    line = prose(98, 70)
    near = line.split()
    near[30] = "changed"
    texts = [prose(1, 60) + " " + passage + " " + prose(2, 30), prose(3, 20) + "\n" + passage + " tail", line + "\nfoo", "bar\n" + " ".join(near), prose(4, 200), None, ""]
    found = substring_dedup.repeated_paragraphs(docs(spark, texts))
    got = found.toPandas()
    assert set(got.doc_id) == {0, 1, 2, 3} and set(got[got.removed].doc_id) == {1, 3}
    for r in got.itertuples():
        assert len(texts[r.doc_id][r.start : r.stop].split()) == r.n_words
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs(spark, texts), found).collect()}
    assert cut[0] == texts[0] and len(cut[1].split()) <= 82 - 45 and cut[6] == ""
    assert substring_dedup.repeated_paragraphs(docs(spark, texts[4:])).count() == 0
    assert substring_dedup.repeated_paragraphs(docs(spark, [])).count() == 0


def test_substring_dedup_without_stops(spark):
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    texts = []
    for i in range(40):  # a shared run of 51 words, at other places of two texts without sentence ends
        shared = plain(1000 + i, 51)
        texts += [f"{plain(2000 + i, 5 + 3 * i)} {shared} {plain(3000 + i, 30)}", f"{plain(4000 + i, 90 - i)} {shared} {plain(5000 + i, i)}".strip()]
    texts += ["In. " * 70 + plain(1, 60), plain(2, 20) + " " + "In. " * 70, plain(3, 300)]
    found = substring_dedup.repeated_paragraphs(docs(spark, texts), line_words=1000)
    got = found.toPandas()
    assert set(got.doc_id) == set(range(82)) and set(got[got.removed].doc_id) == {*range(1, 80, 2), 80, 81}
    assert all(" ".join(texts[r.doc_id][r.start : r.stop].split()) in " ".join(texts[int(r.keep_doc_id)].split()) for r in got[got.doc_id < 80].itertuples())
    assert all(len(texts[r.doc_id][r.start : r.stop].split()) == r.n_words for r in got.itertuples())
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs(spark, texts), found).collect()}
    assert all(cut[i] == texts[i] for i in range(0, 80, 2)) and all(len(cut[i].split()) <= len(texts[i].split()) - 45 for i in range(1, 80, 2))


def template_lines(n):
    """n pairs of lines over one template: alike within a pair (0.8 or more), unlike across pairs, with most band keys in common."""
    lines = []
    for i in range(n):
        words = prose(7, 100).split()
        words[40:47] = [f"own{i}x{j}" for j in range(7)]
        other = list(words)
        other[5 + i % 20], other[60 + i % 30] = f"edit{i}", f"more{i}"
        lines += [" ".join(words), " ".join(other)]
    return lines


def test_substring_dedup_hot_keys(spark):
    lines = template_lines(120)
    hashes, text, _, _ = word_hashes(lines)
    tokens, of = shingles(hashes, text, len(lines), 5)
    sets = [set(tokens[of == i].tolist()) for i in range(len(lines))]
    alike = {(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert alike == {(i + 1, i) for i in range(0, len(lines), 2)}
    got = substring_dedup.repeated_paragraphs(docs(spark, lines)).where("kind = 'line'").toPandas()
    component = dict(zip(got.doc_id, got.component, strict=True))
    found = {(i, j) for i, j in alike if component.get(i, -1) == component.get(j, -2)}
    assert len(found) / len(alike) == 1 and len(set(component.values())) == len(alike)


def test_substring_dedup_recall(spark):
    """Paragraphs at the threshold, by brute force: no colliding pair is lost, and nearly all pairs collide."""
    rng, lines = random.Random(11), []
    for f in range(40):
        base = prose(300 + f, 90).split()
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            lines.append(" ".join(w))
    label, _ = brute_components(lines, 5, 80, 100)
    got = substring_dedup.repeated_paragraphs(docs(spark, lines)).where("kind = 'line'").toPandas()
    component = dict(zip(got.doc_id, got.component, strict=True))
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if label[i] == label[j]]
    found = [p for p in pairs if component.get(p[0], -1) == component.get(p[1], -2)]
    assert len(found) >= 0.99 * len(pairs) and all(label[r.doc_id] == label[r.keep_doc_id] for r in got.itertuples())


def test_substring_dedup_cuts_long_lines(spark):
    """Near copies of a long passage inside lines without ends: cut alike by their own words, and found by their bands."""
    shared = prose(70, 900).replace(".", "").split()
    edited = list(shared)
    for i in range(100, 900, 150):
        edited[i] = f"edit{i}"
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    texts = [f"{plain(71, 400)} {' '.join(shared)} {plain(72, 100)}", f"{plain(73, 150)} {' '.join(edited)}", plain(74, 700)]
    got = substring_dedup.repeated_paragraphs(docs(spark, texts, ids=[4, None, 9])).where("kind = 'line'").toPandas()
    near = got[got.removed]
    assert len(near) >= 3 and near.doc_id.isna().all() and set(near.keep_doc_id) == {4}
    assert all(len(texts[1][r.start : r.stop].split()) == r.n_words for r in near.itertuples())
    odd = docs(spark, ["a " * 60, "a " * 60]).withColumnRenamed("lang", "_gone").withColumnRenamed("score", "start")
    cut = substring_dedup.without_repeats(odd, substring_dedup.repeated_paragraphs(odd))
    assert cut.columns == odd.columns and cut.where("doc_id = 1").first()["text"].strip() == ""


def test_decontaminate(spark):
    items = [prose(50 + i, 30) for i in range(6)] + ["short", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    typo = items[1][:40] + "XY" + items[1][43:]
    texts = [prose(1, 50) + "\n" + items[0].upper().replace(" ", "  ") + " end", "a " + typo, items[2] + " " + items[3], prose(9, 400), items[4][:60], None, ""]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (2, 3)} and got[0, 0]["edits"] == 0 and 0 < got[1, 1]["edits"] <= 3
    r = got[0, 0]
    assert decontaminate.normal(texts[0][r["start"] : r["stop"]]) == decontaminate.normal(items[0])
    short = spark.createDataFrame([(1, "Paris is"), (2, "What is 2?"), (3, "a"), (4, " ")], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, ["so paris  IS, there", "parish is", "xwhat is 2?", "(what is 2?)"], ids=[0, 1, 2, None]), short)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 1), (None, 2), (2, 2)}
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0 and decontaminate.contaminated(docs(spark, texts), bench.where("false")).count() == 0


def test_banded_alignment_against_full_table():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(4) for _ in range(12)]
        text = [rng.randrange(4) for _ in range(20)]
        rows = [[0] * 21]
        for i, a in enumerate(item):
            row = [i + 1]
            for j, b in enumerate(text):
                row.append(min(rows[-1][j] + (a != b), rows[-1][j + 1] + 1, row[-1] + 1))
            rows.append(row)
        best = min(rows[-1])
        run = decontaminate.align(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64), 12)
        assert run[0] == best
        assert decontaminate.align(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64), best - 1) is None
        low, high = rng.randrange(-4, 4), rng.randrange(4, 12)  # a band: paths that leave it don't count
        far = [[10**6] * 21 for _ in range(13)]
        far[0] = [0 if low <= j <= high else 10**6 for j in range(21)]
        for i, a in enumerate(item):
            for j in range(21):
                if low <= j - i - 1 <= high:
                    far[i + 1][j] = min(far[i][j] + 1 if j - i <= high else 10**6, far[i + 1][j - 1] + 1 if j else 10**6, far[i][j - 1] + (a != text[j - 1]) if j else 10**6)
        run = decontaminate.align(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64), 12, low, high)
        assert run and run[0] == min(far[-1])


def test_decontamination_regions_lose_nothing():
    """Every window within the edit budget is in a region that meets the bound, by brute force over random edits."""
    rng = random.Random(8)
    for _ in range(40):
        text = prose(rng.randrange(10**6), 25).lower().replace(".", "")
        items = decontaminate.Items(10, 0.08)
        items.add(1, text)
        items.index()
        edited = list(text)
        for _ in range(items.edits[0]):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], ["#"], ["#", edited[at]]])
        doc = decontaminate.codes(prose(rng.randrange(10**6), 30).lower() + " " + "".join(edited) + " " + prose(5, 10))
        assert decontaminate._found(items, doc, items.regions(doc))
