"""Hard negatives, phrases and byte-level BPE against brute force, the tiktoken library and round trips."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lanewise.llm import bpe, hardneg, phrases

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- 11 --------------------------------------------------------------------------


def brute_negatives(rows, anchors, positives=5, negatives=5, low=80, high=100, scale=256):
    """rows: (id, vector, label); one row for an id."""
    whole = {i: (label, [int(np.floor(scale * float(x))) for x in v]) for i, v, label in rows if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a in [i for i in whole if i in anchors]:
        label, v = whole[a]
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in whole.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:positives]:
            inside = [i for i in order if whole[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, n, score[p], score[n]) for r, n in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["spread", "ties", "one label", "negative", "high"])
def test_hard_negatives_equal_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hardneg, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(hardneg, "STRIPE_BLOCKS", 2)
    monkeypatch.setattr(hardneg, "GROUP_BLOCKS", 2)
    rng = np.random.default_rng(len(case))
    shift = {"negative": -3.0, "high": 1.0}.get(case, 0.6)
    rows = [(i, (rng.integers(0, 3, 4).astype(float) if case == "ties" else rng.normal(shift, 1, 4)).tolist(), 1 if case == "one label" else int(rng.integers(0, 3))) for i in range(240)]
    rows += [(900, None, 1), (901, [1.0, None, 2.0, 3.0], 1), (902, [1.0, float("nan"), 2.0, 3.0], 1), (903, [float("inf")] * 4, 1), (904, [1.0] * 4, None), (None, [1.0] * 4, 1), (905, [], 1), (906, [1.0] * 5, 1), (907, [1.1] * 5, 2)]
    rows += [rows[0], rows[10], rows[10]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    options = {"high": 150, "low": 50} if case == "high" else {}
    got = hardneg.hard_negatives(df, lambda i: i % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, {i for i in range(1000) if i % 10 == 0}, **options)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert (want == []) == (case in ("one label",))


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(empty, lambda i: i % 100 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(one, lambda i: i % 100 == 0).collect() == []


def test_large_products_are_exact():
    a, b = np.array([[2**24, 2**24 - 1]]), np.array([[2**24, 2**24 - 3], [3, -5]])
    big = hardneg.products(np.repeat(a, 4096, axis=1), np.repeat(b, 4096, axis=1))
    assert big.tolist() == [[4096 * sum(int(x) * int(y) for x, y in zip(a[0], r, strict=True)) for r in b]]


def test_wide_components_are_refused(spark):
    df = spark.createDataFrame([(0, [1e12], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="exact scores"):
        hardneg.hard_negatives(df, lambda i: i % 100 == 0).collect()


def test_combiner_keeps_the_best_of_each_slot():
    rng = np.random.default_rng(3)
    parts = [tuple(rng.integers(0, n, 50) for n in (3, 4, 9, 1000)) for _ in range(5)]
    rows = [r for p in parts for r in zip(*(c.tolist() for c in p), strict=True)]
    got = list(zip(*(c.tolist() for c in hardneg.best(parts, 3)), strict=True))
    want = [r for key in sorted({x[:2] for x in rows}) for r in sorted((x for x in rows if x[:2] == key), key=lambda x: (-x[2], x[3]))[:3]]
    assert got == want


# --- 12 --------------------------------------------------------------------------


def brute_phrases(rows, support, most=5, top=2000, covered=100):
    """rows: (text, lang)."""
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, most + 1):
                count.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    f = {k: v for k, v in count.items() if v >= support}
    inner = {}
    for (lang, p), n in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inner[lang, p[i : i + m]] = max(n, inner.get((lang, p[i : i + m]), 0))
    out = []
    for lang in total:
        own = []
        for (g, p), a in f.items():
            if g == lang and len(p) > 1 and not (100 * inner.get((g, p), -1) >= covered * a):
                score, _, le, ri = min((1000 * a * total[g] // (count[g, p[:k]] * count[g, p[k:]]), k, count[g, p[:k]], count[g, p[k:]]) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), le, ri))
        out += [(lang, r, p.decode(), -a, le, ri, total[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def phrase_rows(seed, n=160):
    rng = random.Random(seed)
    words = ["a", "B", "new", "York", "city", "of", "Éa", "éa", "x y", "it's", "\U0001f600", "\x1cq"]
    text = lambda: "".join(rng.choice(["new york city hall ", "b ", rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ! ", ";", "\x0c"])]) for _ in range(rng.randrange(25)))
    rows = [(text(), rng.choice(["en", "en", "en", "fr", None])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), ("...", "de"), ("a " * 3000, "fr"), rows[0], rows[0]]


@pytest.mark.parametrize("shard,trie", [(1 << 30, 1 << 20), (600, 1 << 20), (600, 0), (1, 1 << 20), (4000, 1 << 20)])
def test_phrases_equal_brute_force(spark, shard, trie):
    rows = phrase_rows(shard % 7)
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, score int").repartition(3)
    for support, top, covered in ((12, 2000, 100), (25, 7, 80)):
        got = phrases.collocations(df, support=support, top=top, covered=covered, shard_bytes=shard, trie_phrases=trie)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, support, top=top, covered=covered)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With a hash of two values only, words are told apart by their bytes."""
    plain = phrases.word_hashes
    poor = lambda h: h % np.uint64(2)
    monkeypatch.setattr(phrases, "word_hashes", lambda *a: (lambda h, s, e: (poor(h), s, e))(*plain(*a)))
    words = phrases.Words([b"a b c a bb", b"c, a"])
    number, one = words.numbers()
    assert [words.text(one[i]) for i in number] == [b"a", b"b", b"c", b"a", b"bb", b"c", b"a"]
    spans = phrases.span_hashes
    monkeypatch.setattr(phrases, "span_hashes", lambda *a: poor(spans(*a)))
    trie = phrases.Trie([["a"], ["bb"], ["c"], ["c", "a"]])
    assert [([None, *trie.names[0]])[i] for i in trie.numbers(words)] == ["a", None, "c", "a", "bb", "c", "a"]


def test_scores_beyond_64_bits(spark, monkeypatch):
    """1000 * a * n passes 64 bits: counts of this size are given, not counted."""
    a, n, le, ri = 7_000_000_001, 900_000_000_000_011, 8_000_000_003, 7_000_000_003
    counts = spark.createDataFrame([("en", 1, "p", le), ("en", 1, "q", ri), ("en", 2, "p q", a)], "lang string, m int, phrase string, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, total long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (counts, totals))
    got = phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    assert [r.score for r in got] == [1000 * a * n // (le * ri)]


# --- 13 --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(seed, n=3000):
    rng = random.Random(seed)
    parts = ["a", "b", "'s", "'ll", " ", "  ", "\n", " ", " ", "é", "漢字", "5", "٣", "\U0001f600", "\x1c", "\x85", "_", "-", "'", "ß", "́", "՘", "　", "\t", "\r\n", "the", "tion", "aaaa", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(n)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(n)]
    return texts + ["", "a" * 20_000, "ab" * 5000, "aab" * 1000 + "é" * 999, " " * 3000 + "a", "\n" * 3000]


@pytest.mark.parametrize("shared", [0, 50, 1 << 17])
def test_ids_equal_the_library(spark, library, shared):
    texts = [*odd_texts(shared), None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH, shared=shared), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()


def test_replay_merges_words_as_one_by_one():
    vocab = bpe.vocabulary(PATH)
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aeinstr \xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(4000)] + [b"a" * 301, b"ab" * 200]
    ids, starts = bpe.replay(words, vocab)
    for w, lo, hi in zip(words, starts[:-1], starts[1:], strict=True):
        assert ids[lo:hi].tolist() == ([vocab.ranks[w]] if w in vocab.ranks else bpe.alone(w, vocab))
    assert bpe.replay([], vocab)[0].tolist() == []


def test_ranks_in_any_order(tmp_path):
    """A vocabulary whose new pairs can have lower ranks than the merge that made them."""
    for seed in range(30):
        rng = random.Random(seed)
        tokens = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(60)})
        rng.shuffle(tokens)
        path = tmp_path / f"{seed}.tiktoken"
        ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        path.write_bytes(b"".join(base64.b64encode(t) + b" " + str(r).encode() + b"\n" for t, r in ranks.items()))
        library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        vocab = bpe.vocabulary(str(path))
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
        ids, starts = bpe.replayed(words, vocab)
        assert [ids[lo:hi].tolist() for lo, hi in zip(starts[:-1], starts[1:], strict=True)] == [library.encode_ordinary(w) for w in words]


def test_groups_of_texts_and_tables_are_bounded(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_CHARS", 40)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 20)
    table = bpe.Table(bpe.vocabulary(PATH), bpe.Shared())
    for t in odd_texts(9, 200):
        numbers = table.numbers(t)
        table.complete()
        assert table.encoded(numbers).tolist() == library.encode_ordinary(t)
        if len(table.number) > 5:
            table.clear()


def test_one_process_encodes_and_decodes(spark):
    """A task of the query holds one Python process beside Spark's, and one vocabulary; its bytes are those of a decoding of their own."""
    plan = bpe.op13_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate([*odd_texts(3, 300), None])], "doc_id long, text string, decoded binary").repartition(3)
    both = bpe.encode(df, PATH, decoded_col="decoded")
    got = sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in both.collect())
    assert got == sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect())
    assert both.columns == ["doc_id", "ids", "decoded"]


def test_bpe_query(spark, library):
    got = {r.doc_id: r for r in bpe.op13_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    empty = bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert empty.select(F.size("ids")).collect() == []


# --- 10: long runs ---------------------------------------------------------------


def test_base_matches_equal_the_patterns():
    from lanewise.llm import pii

    rng = random.Random(6)
    parts = ["a", "b.", "@", "@@", "1", "22", ".", "..", "-", "+", "%", " ", "é", "x@y.z", "1.2.3.4", "(", "9" * 13, "c_d", "a-b.c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    texts += ["9" * 4000, "a" * 3000 + "@" + "b" * 3000, "1." * 2000, "1.1.1.1." * 500, "a@" * 1500, "a.b@c.d" * 500, "." * 3000 + "@a.b", "1..2.3.4.5.6.7.8.9"]
    for t in texts:
        for kind, pattern in pii.BASE.items():
            assert list(pii.matches(kind, t)) == [m.span() for m in pattern.finditer(t)], (kind, t[:80])


@pytest.mark.parametrize("text", ["9" * 1_000_000, "aB3" * 333_000 + " @ " + "x" * 10, "a" * 1_000_000 + "@b.c", "1.1.1.1." * 125_000, "+1" + " (" * 400_000, "a@" * 500_000, "1-" * 500_000])
def test_long_runs_take_seconds(text):
    import time

    from lanewise.llm import pii

    began = time.process_time()
    pii.base_spans(text)
    found = pii.candidates(text)
    assert time.process_time() - began < 10
    for c in found[:3]:
        pii.features(text, *c)
    assert time.process_time() - began < 12


# --- 2: late rewrites ------------------------------------------------------------


@pytest.mark.parametrize("look_back", [1, None])
def test_a_rewrite_after_millions_of_characters_is_noticed(look_back):
    from lanewise.llm import chat

    class Late(chat.TurnTemplate):
        """Counts all turns at the very start once there are more than 40."""

        def render(self, turns):
            return ("" if len(turns) <= 40 else f"({len(turns)})") + super().render(turns)

    Late.look_back = look_back
    renderer = chat.Renderer(Late())
    turns = [("user", "x" * 60_000)] * 45
    if look_back is None:
        for t in turns:
            renderer.add(*t)
        renderer.finish()
        assert renderer.rewrites
    else:
        with pytest.raises(ValueError, match="look-back"):
            for t in turns:
                renderer.add(*t)
            renderer.finish()


def test_chat_query_renders_prefixes():
    from lanewise.llm import chat

    asked = []

    class Spy(chat.WholePrefixes):
        def render(self, turns):
            asked.append(len(turns))
            return super().render(turns)

    renderer = chat.Renderer(Spy())
    for i in range(6):
        renderer.add("user", f"{i}")
    assert max(asked) == 6
    assert set(range(7)) <= set(asked)


# --- 1: leaves in the join -------------------------------------------------------


def test_floors_are_below_what_is_found():
    from lanewise.llm import ann

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 6)).astype(np.float32)
    forest = ann.Forest(x, 3, 4, 1)
    leaf, q = forest.leaves(x), x[::30]
    popped = forest.popped(q, 5)
    least = ann.floors(x[:300], leaf[:300], q, popped, 48, 11)
    for i in range(len(q)):
        met = lambda rows: sorted(x[:rows][np.isin(leaf[:rows], popped[i]).any(axis=1)].astype(float) @ q[i].astype(float))  # noqa: B023, E731
        own = met(300)
        assert abs(least[i] - own[-11]) < 1e-9 if len(own) >= 11 else least[i] == -np.inf
        assert sum(s >= least[i] for s in met(900)) >= min(11, len(met(900)))
    assert np.isinf(ann.floors(x[:5], leaf[:5], q, popped, 48, 11)).all()


def test_partial_results_do_not_grow_with_the_tasks(spark):
    """Leaves that lie in a task each hand on little more than what is found in the end."""
    from lanewise.llm import ann

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (2_000, 16)))], "vec_id long, embedding array<double>")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in held}
    try:
        for c, v in held.items():
            spark.conf.set(c, v)
        found = ann.nearest_neighbours(df, lambda i: i % 20 == 0, k=10).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().apply(store.executionsList().size() - 1).executionId()
    nodes, values = store.planGraph(last).allNodes(), store.executionMetrics(last)
    (score,) = [n for n in map(nodes.apply, range(nodes.size())) if n.desc().startswith("MapInArrow score")]
    made = [values.get(m.accumulatorId()).get() for m in map(score.metrics().apply, range(score.metrics().size())) if m.name() == "number of output rows"]
    assert len(found) == 1_000
    assert int(made[0].replace(",", "")) < 4 * len(found)


def test_table_larger_than_the_sample_and_a_hot_leaf(spark, monkeypatch):
    """Recall on a table of twenty times the sample, a third of it in one tight cluster, whose leaf is joined in several parts."""
    from lanewise.llm import ann

    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(0, 1, (4_000, 8)), np.full(8, 3.0) + rng.normal(0, 1e-3, (2_000, 8))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, lambda i: i % 40 == 0, k=10, sample_rows=300, leaf_rows=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x[::40] @ x.T
    hits = 0
    for row, q in zip(scores, range(0, 6_000, 40), strict=True):
        row[q] = -np.inf
        least = np.sort(row)[-10]
        hits += sum(row[i] >= least - 1e-9 for i in got[q])
    assert hits >= 0.9 * 10 * 150


# --- 5: many sources -------------------------------------------------------------


@pytest.mark.parametrize("queues,window", [(1, 64), (7, 64), (300, 512), (5_000, 1_024)])
def test_every_source_keeps_its_share_in_every_window(queues, window, monkeypatch):
    from fractions import Fraction

    from lanewise.llm import packing

    monkeypatch.setattr(packing, "QUEUE_TOKENS", 2)
    rng = random.Random(queues)
    totals = [rng.choice([1, 2, 30, rng.randrange(1, 200)]) for _ in range(queues)]
    shares = packing.Shares(totals, window)
    place = np.full(sum(totals), -1)
    for q, n in enumerate(totals):
        done = 0
        while done < n:  # documents of several lengths
            m = min(n - done, rng.randrange(1, 90))
            for offset, at, length in shares.runs(q, done, m):
                assert (place[at : at + length] == -1).all()
                place[at : at + length] = q
            done += m
    assert (place >= 0).all()
    # A window holds what has been earned up to its end but for less than a token of each queue.
    for w in range(1, shares.windows):
        end = sum(shares.sent(q, w) for q in range(queues))
        counts = np.bincount(place[:end], minlength=queues)
        assert all(0 <= w * shares.window * n / shares.tokens - c < 1 + 1e-9 for n, c in zip(totals, counts, strict=True))
    if queues <= 300:  # the same layout as the general form
        general = packing.Schedule(totals, [Fraction(n) for n in totals], shares.window)
        for q in range(queues):
            assert list(shares.runs(q, 0, totals[q])) == list(general.runs(q, 0, totals[q]))


def test_five_thousand_sources_are_packed(spark):
    from lanewise.llm import packing

    rows = [(i, f"word {i} " * (1 + i % 5), f"s{i % 5_000}") for i in range(10_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).drop("ids").collect()
    spans = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert len({r.doc_id for r in got}) == 10_000


def test_many_shards_name_possible_phrases_only(spark):
    rng = random.Random(17)
    rows = [(" ".join(rng.choice(["the cat sat", "on a mat", f"w{rng.randrange(3_000)}", f"w{rng.randrange(40)}"]) for _ in range(40)), rng.choice(["en", "de"])) for _ in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    known = phrases._possible(docs, 20, 5, 2_000, 8, 10_000)
    assert len(known) == phrases.FILTERED_WORDS
    totals = {lang: sum(len(t.split()) for t, x in rows if x == lang) for lang in ("en", "de")}
    named = lambda hashes: phrases._mined(docs, totals, 20, 5, 2_000, 8, hashes).where("m > 0").selectExpr("sum(size(phrases))").first()[0]
    assert named(known) < named(None) / 3
    counts, _ = phrases.phrase_counts(docs, 20, 5, 2_000)
    want = Counter((lang, " ".join(w[i : i + m])) for t, lang in rows for w in [t.split()] for m in range(1, 6) for i in range(len(w) - m + 1))
    assert {(r.lang, r.phrase): r.n for r in counts.collect()} == {k: n for k, n in want.items() if n >= 20}
    # Too many hashes of a length: it and longer ones are left unfiltered.
    assert phrases._possible(docs, 20, 5, 2_000, 8, 5) == []
