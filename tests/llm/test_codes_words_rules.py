"""Vector codes, spelling variants and quality rules: brute force on small tables, and the defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from litsieve.llm import fertility, queries, spelling, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, label int, code string, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTORS)


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Codes by Lloyd rounds over rows in one place."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max(len(v) for _, v, _ in kept)
    width = -(-longest // parts)
    cells = [[max(-(1 << 24), min(1 << 24, math.floor(4096 * float(np.float32(x))))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    ids = sorted({i for i, _, _ in kept if i is not None}) + [None] * any(i is None for i, _, _ in kept)
    first = [min(c for (j, _, _), c in zip(kept, cells) if j == i) for i in ids[:entries]]
    part = lambda c, p: c[p * width : (p + 1) * width]
    books = [[part(c, p) for c in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda c, p: min((far(part(c, p), b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        met = defaultdict(list)
        for c in cells:
            for p in range(parts):
                met[p, nearest(c, p)[1]].append(part(c, p))
        for (p, e), members in met.items():
            books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    found = [[nearest(c, p) for p in range(parts)] for c in cells]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return sorted((repr((i, "".join(f"{e:02x}" for _, e in f), err, labels[label], sha)) for (i, _, label), f, err in zip(kept, found, errors)))


@pytest.mark.parametrize("kind", ["plain", "odd", "few", "copies"])
def test_vector_codes(spark, kind):
    rng = random.Random(kind)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(16)], rng.choice([None, 0, 1, 2])) for i in range(120)]
    if kind == "odd":
        rows += [(3, None, 1), (4, [None] * 16, 1), (5, [float("nan")] * 16, 1), (6, [float("inf")] * 16, None), (None, [0.5] * 16, 1), (None, [-0.5] * 16, 1)]
        rows += [(7, rows[0][1], 2), (200, [0.1, -0.2, 5e8], 2), (201, [], None), (8, rows[8][1], 0), (0, [-2.0] * 16, 0)]
    if kind == "few":
        rows = rows[:5] + [(2, [0.0] * 11, 7)]
    if kind == "copies":
        rows += [(1000 + i, [0.25] * 16, 5) for i in range(200)]
    got = vector_codes.codes(vectors(spark, rows)).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == lloyd(rows)


def test_vector_codes_move_only_what_changed(spark):
    rows = [(i, [random.Random(i).uniform(-1, 1)] * 8, 0) for i in range(300)]
    kept = vector_codes.quantised(vectors(spark, rows))
    cut = kept.selectExpr("row", "vec_id", "label", "0L as salt", "v", "explode(sequence(0, 7)) as pos").selectExpr("row", "vec_id", "label", "salt", "pos", "slice(v, pos + 1, 1) as part")
    books = vector_codes.seeds(kept, 8, 16, 1)
    state = vector_codes.Residents(spark)
    state.keep(vector_codes.assigned(cut, books).withColumn("home", vector_codes.F.col("entry")).repartition(4, *vector_codes.OWNER))
    state.keep(vector_codes.assigned(state.settled(), state.updated(books)))
    moving = spark.table(state.name).where("entry <> home").count()
    assert 0 < moving < 2400
    plan = state.settled()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Union") < plan.index("Exchange")  # only one arm of the union is shuffled
    assert state.settled().where("home <> entry").count() == 0 and state.settled().count() == 2400
    state.drop()
    assert vector_codes.codes(vectors(spark, [])).count() == 0 and vector_codes.codes(vectors(spark, [(1, None, 1)])).count() == 0


def spelled(rows):
    """Words and forms by trying all edits of every word."""
    counts, low = Counter(), str.maketrans(spelling.UPPER, spelling.LOWER)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 3}
    letters = sorted({c for w in n for c in w})
    near = {w: {e for e in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + d :] for c in letters for d in (0, 1) for i in range(len(w) + 1 - d)} if e in n and e != w} for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        end = w
        while end in form:
            end = form[end]
        out.append((w, form.get(w), end, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def variants(seed, n):
    rng, base = random.Random(seed), ["kitten", "sitting", "übergang", "letters", "aaaaa", "aaaaaa", "stressed", "desserts", "caféteria"]
    out = []
    for _ in range(n):
        w = rng.choice(base) if rng.random() < 0.8 else "".join(rng.choice("ab×Ä") for _ in range(rng.randrange(4, 8)))
        if rng.random() < 0.4:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abeé") + w[i:], w[:i] + rng.choice("abeé") + w[i + 1 :]])
        out.append(rng.choice([w, w.upper() if w.isascii() else w, w.title() if w.isascii() else w]))
    return rng.choice([" ", "-", "1"]).join(out)


def test_spelling_variants(spark):
    rows = [(i % 50, variants(i, 60)) for i in range(80)] + [(None, variants(99, 200)), (1, None), (2, ""), (3, "ЖЖЖЖЖЖ 12345"), (4, "doubles " * 3), (5, "longest" * 3000 + " "), (5, variants(7, 4000))]
    rows += [(6, "planting " * 41 + "plantinx " * 20 + "plantizx " * 9), (7, "plantizq " * 4)]
    frame = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    got = sorted(tuple(r) for r in spelling.groups(frame).collect())
    assert got == spelled(rows) and sum(r[1] is not None for r in got) > 50
    assert any(r[1] and r[1] != r[2] for r in got)  # paths of several steps
    assert spelling.groups(frame.limit(0)).count() == 0


def test_partenum_loses_no_pair():
    """Every pair one edit apart shares a signature, half and tag included."""
    import pyarrow as pa

    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(5, 12)))
        i = rng.randrange(len(a))
        for b in (a[:i] + a[i + 1 :], a[:i] + rng.choice("xyz") + a[i + 1 :], a[:i] + rng.choice("abx") + a[i:]):
            batch = pa.record_batch([pa.array([a, b]), pa.array([1, 1])], names=["word", "n"])
            met = defaultdict(set)
            for out in spelling._signatures([batch], 3, 2):
                for sig, role, word in zip(*(out.column(c).to_pylist() for c in ("sig", "role", "word"))):
                    met[sig].add((role, word))
            roles = (spelling.SAME, spelling.SAME) if len(a) == len(b) else (spelling.SHORTER, spelling.LONGER)
            pair = set(zip(roles, sorted((a, b), key=len)))
            assert a == b or any(pair <= m for m in met.values()), (a, b)


def base(text):
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    inside = {k + d for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def fertile(text):
    """The measures, token by token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    ids = [i for w in WORD.findall(text) for i in model.encode(w)]
    if not ids:
        return 0, 0.0, 0.0, 0.0
    n = len(ids)
    begins = [0] if n <= 128 else [*range(0, n - 128, 128), n - 128]
    bits = []
    for b in begins:
        part = Counter(ids[b : b + 128])
        size = sum(part.values())
        h = -sum(c / size * math.log2(c / size) for c in part.values())
        bits.append(h if size == 128 else h * 7 / math.log2(max(2, size)))
    return len(begins), base(text)[1] / n, sum(model.is_byte(i) for i in ids) / n, sum(bits) / len(bits)


def ruled(frame, **more):
    return fertility.judged(frame, queries.tokenizer_path("piece_bpe_32k.model"), queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, **more)


def test_quality_rules(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = [prose(rng.randrange(60, 900)) for _ in range(90)]
    junk = [" ".join(w + "&&&" for w in prose(200).split()) for _ in range(4)] + [" ".join(rng.choice(["\U0001f600\U0001f601", "ሴስ"]) + w for w in prose(150).split()) for _ in range(2)]
    odd = [None, "", " \t\n\x0b", "one two", "a b c " * 40, "same line\nsame line\n\n \nother\nsame line", "x" * 60_000, "café     \U0001f600 <b> " * 30, prose(20_000)]
    texts = clean + junk + odd
    rows = [(None if t is None else i, t, "en" if i % 9 else None, "g", 1.0, 2) for i, t in enumerate(texts)] + [(0, texts[0], "en", "g", 1.0, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, group string, kept double, own int")
    got = {r.doc_id: r for r in ruled(frame).collect()}
    assert ruled(frame).count() == len(rows)
    for i, text in enumerate(texts):
        r = got[None if text is None else i]
        text = text or ""
        want = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.base_failed or not r.kept)
        stretches, chars, share, bits = fertile(text)
        assert r.stretches == stretches and np.allclose([r.chars_per_token, r.byte_share, r.token_entropy], [chars, share, bits])
    assert all(got[i].kept for i in range(len(clean))) and not any(got[i].kept for i in range(len(clean), len(clean) + len(junk)))
    assert {got[90 + i].reason for i in range(4)} <= set(fertility.BANDS) and got[0].group == "script latin" and got[1].group == "lang en"
    assert ruled(frame.limit(0)).count() == 0 and ruled(frame.drop("lang").limit(5)).count() == 5


def test_bands_are_exact_medians(spark):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.7 else "b", rng.random() < 0.1, *(rng.uniform(0, 5) for _ in fertility.BANDS)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "group string, base_failed boolean, " + ", ".join(f"{m} double" for m in fertility.BANDS))
    got = {(r.group, r.measure): r for r in fertility.bands(frame).collect()}
    for group in ("", "a", "b"):
        for i, measure in enumerate(fertility.BANDS):
            q = sorted(math.floor(1000 * r[2 + i] + 0.5) for r in rows if not r[1] and group in ("", r[0]))
            lower = lambda x: sorted(x)[(len(x) - 1) // 2]
            r = got[group, measure]
            assert r.total == len(q) and r.middle == lower(q) and abs(r.scale - 1.4826 * lower([abs(x - r.middle) for x in q])) < 1e-9
