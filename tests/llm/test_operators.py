"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import ann, chat, decontam, htmltext, langid, licenses, neardup, packing, pii, secrets
from lanewise.llm.common import shingle_sets, word_groups

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOC)


# --- word sets -----------------------------------------------------------------


def test_shingles_equal_plain_sets():
    rng = random.Random(0)
    texts = ["", None, "one", "A b\tC", "  x  y ", "é É ü", *[" ".join(rng.choices(WORDS[:9], k=rng.randrange(40))) for _ in range(50)]]
    for n in (1, 2, 5):
        for first, last, hashes, offsets in word_groups(texts, 64):
            sets, bounds = shingle_sets(hashes, offsets, n)
            for i in range(first, last):
                w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i] or ""))
                want = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
                assert bounds[i - first + 1] - bounds[i - first] == len(want)


# --- 1 ---------------------------------------------------------------------------


def test_priority_queue_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    forest = ann.Forest(x, trees=3, depth=4, seed=1)
    for q in x[:20]:
        queue = [(0.0, t, 0, 0) for t in range(3)]
        popped = []
        while len(popped) < 9:
            p, t, node, level = heapq.heappop(queue)
            if level == 4:
                popped.append(node - 15 + (t << 4))
                continue
            m = float(np.float32(forest.normals[t, node] @ q - forest.cuts[t, node]))
            heapq.heappush(queue, (p + max(m, 0) ** 2, t, 2 * node + 1, level + 1))
            heapq.heappush(queue, (p + min(m, 0) ** 2, t, 2 * node + 2, level + 1))
        assert set(forest.popped(q[None], 9)[0].tolist()) == set(popped)


def test_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)).round(2)
    x[50:90] = x[50]  # equal vectors
    table = [(i, [float(v) for v in r], i) for i, r in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [None] * 8, 0), (1004, [1.0] * 3, 0), (None, [1.0] * 8, 0), (7, [float(v) for v in x[7]], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, v int")
    got: dict = {}
    for r in ann.nearest_neighbours(df, lambda i: i % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        best = sorted((-float((x[q] * x[i]).sum()), i) for i in range(400) if i != q)[:5]
        hits += len({f[1] for f in found} & {i for _, i in best})
        assert all(s == pytest.approx(float((x[q] * x[i]).sum()), abs=1e-12) for _, i, s in found)
    assert hits >= 0.95 * 5 * len(got)
    assert ann.nearest_neighbours(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_fewer_candidates_than_wanted(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest_neighbours(df, lambda i: i == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    forest = ann.Forest(ann.lengthened(x, np.linalg.norm(x, axis=1).max() + 1e-6), 4, 5, 1)
    assert forest.depth == 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.nearest_neighbours(df, lambda i: i % 20 == 0, k=10, leaf_rows=90).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    wide, hits = x.astype(np.float64), 0
    for q in range(0, 3000, 20):
        score = wide @ wide[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:10].tolist()))
    assert 0.9 <= hits / (10 * len(got)) < 1.0  # not all leaves are looked at


def test_ties_go_to_smaller_ids(spark):
    one_hot = np.eye(64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(one_hot)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, lambda i: i == 20, recall=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))
    rng = np.random.default_rng(4)
    x = rng.integers(-1, 2, (600, 6))
    x[(x == 0).all(axis=1), 0] = 1
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in ann.nearest_neighbours(df, lambda i: i % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 600, 20):
        assert found[q] == [i for _, i in sorted((-int(x[q] @ x[i]), i) for i in range(600) if i != q)[:20]]


def test_repeated_ids_have_one_vector(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest_neighbours(df, lambda i: i == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]


# --- 2 ---------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "###", "\\", "a\nb: </turn>\n### assistant: x", "\\\\###</turn"]
    table = [(c, t, ("user", "assistant", None, "x:y###")[t % 4], hard[(c + t) % 7]) for c in range(5) for t in range(23)] + [(None, 0, "user", "n"), (9, None, "assistant", "late"), (9, 1, "user", "tie"), (9, 1, "user", "tie")]
    df = spark.createDataFrame(table, TURN).withColumn("place", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by: dict = {}
    for c, t, role, text in table:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        assert (r.n_turns, r.rewrites) == (len(turns), False)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.TurnTemplate().render([(a, b) for _, a, b in turns]))
    assert chat.format_conversations(df.limit(0)).count() == 0


class Rewriting(chat.TurnTemplate):
    """Drops all but the last two turns' texts."""

    look_back = None

    def render(self, turns):
        return super().render([(r, t if len(turns) - i <= 2 else "") for i, (r, t) in enumerate(turns)])


class FarSighted(chat.TurnTemplate):
    """Says at each turn how many there were before."""

    look_back = None

    def render(self, turns):
        return "<s>" + "".join(f"{i}{super(FarSighted, self).render([t])}" for i, t in enumerate(turns))

    def open_turn(self, turns, role):
        return self.render(turns) + f"{len(turns)}### {role}: "


def test_templates_that_rewrite_or_look_far():
    r = chat.Renderer(Rewriting())
    for i in range(4):
        r.add("user", f"t{i}")
    assert r.rewrites
    r = chat.Renderer(FarSighted())
    pieces = [r.add("user", f"t{i}")[0] for i in range(20)]
    assert not r.rewrites
    assert pieces[12] == "12### user: t12</turn>\n"


class LastTwelve(chat.TurnTemplate):
    look_back = None

    def render(self, turns):
        return super().render(turns[-12:])


class LateHeader(chat.TurnTemplate):
    look_back = None

    def render(self, turns):
        return ("long\n" if len(turns) > 10 else "") + super().render(turns)


@pytest.mark.parametrize("template", [LastTwelve, LateHeader, FarSighted])
def test_templates_that_look_far_back(template):
    turns = [("user", f"t{i}") for i in range(30)]
    r = chat.Renderer(template())
    pieces = [r.add(*t)[0] for t in turns]
    assert r.rewrites == ("".join(pieces) != template().render(turns)) == (template is not FarSighted)
    declares = type("Declares", (template,), {"look_back": 8})
    r = chat.Renderer(declares())
    with pytest.raises(ValueError, match="look-back of 8"):
        [r.add(*t) for t in turns] and r.finish()


# --- 3 ---------------------------------------------------------------------------


def test_secrets_and_ledger(spark):
    texts = ["token = \"abcdef123\" and AKIA" + "A1" * 10, "PassWord:short", None, "", "é api_key='0123456789abcdef0123456789' é", "x" * 30000 + " secret=abcdefgh", "token = \"abcdef123\" and AKIA" + "A1" * 10, "ſecret=abcdefgh", "deadbeef" * 3]
    df = docs(spark, texts).withColumn("blob", F.lit("clash"))
    found, ledger = secrets.scan_secrets(df)
    for r in secrets.digest(found, tuple(x.kind for x in secrets.RULES)).collect():
        spans, want = secrets.brute_force(texts[r.doc_id])
        assert r.base_sha256 == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in spans) for x in secrets.BASE)
    ledger = ledger.cache()
    assert ledger.count() == 7 * len(secrets.RULES)  # distinct blobs: null and empty are one, two are copies
    newer = (secrets.Rule("assign", 2, r"never", 0), *secrets.RULES[1:])
    again, after = secrets.scan_secrets(df.unionByName(docs(spark, ["token=zzzzzzz"]).withColumn("blob", F.lit(""))), ledger, newer)
    assert after.count() - ledger.count() == 7 + len(newer)  # the new version for old blobs, all rules for the new blob
    kinds = {f.kind for r in again.collect() for f in r.findings}
    assert "assign" not in kinds
    assert "access" in kinds  # from the ledger
    assert secrets.scan_secrets(df.limit(0))[0].count() == 0


def test_secrets_query_scans_a_blob_once(spark, tmp_path):
    texts = ["token=abcdef1", "x", "token=abcdef1", "key " + "ab12" * 8, "x", "token=abcdef1", None]
    df = docs(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.base_sha256 for r in secrets.op3_secrets(spark, str(tmp_path)).collect()}
    assert got == {i: secrets.brute_force(t)[1] for i, t in enumerate(texts)}
    _, first = secrets.scan_secrets(df.where("doc_id < 3"))
    _, both = secrets.scan_secrets(df.where("doc_id >= 3"), first)
    assert both.count() - first.count() == 2 * len(secrets.RULES)  # of the later four only the key and the null text are new


@pytest.mark.parametrize(("text", "kind"), [("x -----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY----- y", "pem"), ("a eyJabcdefgh.abcdefgh.abcdefgh b", "jwt"), ("g ghp_" + "a1" * 18 + " h", "prefixed"), ("Bearer   abcdef0123456789xyz", "bearer"), ("see ftp://joe:pw@host/x", "url")])
def test_further_kinds_of_secrets(spark, text, kind):
    found = secrets.scan_secrets(docs(spark, [text, "plain words only"]))[0].orderBy("doc_id").collect()
    assert kind in {f.kind for f in found[0].findings}
    assert found[1].findings == []


# --- 4 ---------------------------------------------------------------------------


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rng = random.Random(words)
    passage = rng.choices(WORDS, k=60)
    texts = ["", None, "one", "one", "One", "a b", "a  b"]
    for _ in range(6):  # groups of near copies with different shares of edits
        base = rng.choices(WORDS, k=120)
        texts += [" ".join(w if rng.random() > e else "new%d" % rng.randrange(10**6) for w in base) for e in (0, 0.02, 0.03, 0.05, 0.06, 0.08, 0.1) for _ in range(3)]
    texts += [" ".join(passage + rng.choices(WORDS, k=15)) for _ in range(40)]  # a common passage
    texts += [" ".join(rng.choices(WORDS, k=rng.randrange(30))) for _ in range(40)]
    want, sizes = brute_components(texts, words, 80)
    got = neardup.near_duplicates(docs(spark, texts).withColumn("n", F.lit(1)), words=words).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, sizes[i], c, i == c) for i, c in enumerate(want)}


def test_near_duplicates_edges(spark):
    df = docs(spark, ["same text here", "same text here"]).unionByName(docs(spark, ["same text here"])).unionByName(spark.createDataFrame([(None, "x", "en", "s", 1)], DOC))
    assert [r.component_id for r in neardup.near_duplicates(df).collect()] == [0, 0, 0]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.deduplicated(df).count() == 2  # one of the group, and the row without an id


def test_unlike_texts_under_one_id(spark):
    table = [(1, "a b c d e f g"), (1, "x y z"), (1, "x  y z"), (1, "x y z"), (2, "q"), (3, "X Y Z"), (4, ""), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in table], DOC)
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()) == [(1, 1)] * 4 + [(2, 2), (3, 1), (4, 4), (4, 4)]
    kept = sorted((r.doc_id, " ".join(r.text.split())) for r in neardup.deduplicated(df).collect())
    assert kept == [(1, "a b c d e f g"), (1, "x y z"), (2, "q"), (4, "")]


# --- 5 ---------------------------------------------------------------------------


def test_a_target_among_many_sources(spark):
    df = spark.createDataFrame([(i, f"word{i} " * (1 if i == 0 else 3), "en", f"s{i}", 0) for i in range(1101)], DOC)
    pieces = packing.pack(df, targets={"s0": 1.0}, window=256, sequence=64).where("doc_id = 0").collect()
    assert [(p.sequence_id, p.offset) for p in pieces] == [(0, 0)]
    placed = packing.pack(df, window=256, sequence=64)
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("c")).where("n <> 64 or k <> c").count() == 1  # the last one


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ["", None, "a", " a  b \n", "don't  stop 12 34 ", "é　x y <|endoftext|> \xa0z f é", "word " * 3000, "<|endoftext|><|endoftext|>", " " * 1_000_000, *[" ".join(rng.choices(WORDS, k=rng.randrange(300))) for _ in range(60)]]
    df = spark.createDataFrame([(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", 0) for i, t in enumerate(texts)], DOC).withColumn("part", F.lit(3)).repartition(3)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for targets in (None, {"s0": 1.0, "s1": 3.0}):
        pieces = packing.pack(df, targets=targets, window=1024, sequence=256).collect()
        by, seq = {}, {}
        for p in pieces:
            by.setdefault(p.doc_id, []).append(p)
            seq.setdefault(p.sequence_id, []).append(p)
        assert set(by) == set(range(len(texts)))
        for d, parts in by.items():
            ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
            at = 0
            for p in sorted(parts, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        ends = []
        for s in sorted(seq):
            at = 0
            for p in sorted(seq[s], key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            ends.append(at)
        assert all(e == 256 for e in ends[:-1])
        assert sorted(seq) == list(range(len(seq)))
    # In the first window the targets hold, to a token: one of four to s0, three to s1.
    first = {}
    for s in range(4):
        for p in seq[s]:
            first[p.source] = first.get(p.source, 0) + p.length
    assert first == {"s0": 256, "s1": 768}
    assert packing.pack(df.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------


def test_patience_alignment():
    rng = random.Random(6)
    for _ in range(200):
        a, b = rng.choices("abcdefgh", k=rng.randrange(20)), rng.choices("abcdefgh", k=rng.randrange(20))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    for _ in range(100):
        v = [rng.randrange(50) for _ in range(rng.randrange(15))]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        got = [v[i] for i in licenses.longest_increasing(v)]
        assert len(got) == max(best, default=0)
        assert all(x < y for x, y in zip(got, got[1:], strict=False))
    b = list(range(100))
    assert len(licenses.patience([-1, *b[:40], -2, -3, *b[45:], -4], b)) == 95


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "FREE of  charge").replace("sublicense", "relicense")
    texts = ["é " * 50 + mit + " end", "intro. " + edited, mit[: len(mit) // 3], None, "", "Released under the MIT License.\nAll rights reserved. Released under the MIT License.", "nothing to see", "w " * 20000 + "Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: [(x.license, x.start, x.end) for x in r.licenses] for r in licenses.scan_licenses(docs(spark, texts).withColumn("licenses", F.lit(1))).collect()}
    assert [x[0] for x in got[0]] == ["MIT"]
    assert texts[0][got[0][0][1] : got[0][0][2]].startswith("Permission")
    assert [x[0] for x in got[1]] == ["MIT"]
    assert got[2] == got[3] == got[4] == got[6] == []
    assert [x[0] for x in got[5]] == ["MIT-notice", "All-rights-reserved", "MIT-notice"]
    assert got[7] == [("CC-BY-NC-4.0-notice", 40000, 40000 + len("Licensed under CC BY-NC 4.0"))]


def test_repeated_notices(spark):
    mit, apache, rights = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"], "All rights reserved."
    edited = mit.replace("free of charge", "at no cost at all").replace("sublicense", "relicense")
    texts = [f"some text. {rights} B 2021. {rights} more text", f"{rights} {rights} {rights}", f"intro {rights} {rights} end", *[f"a file here. {t} Copyright C 2021 someone. {t} more words" for t in (mit, edited, apache, licenses.TEMPLATES["BSD"])], f"one {edited} {mit} {edited} two", f"x {mit} y {mit[: len(mit) // 2]} z"]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    kinds = [[x.license for x in got[i]] for i in range(len(texts))]
    assert kinds == [["All-rights-reserved"] * 2, ["All-rights-reserved"] * 3, ["All-rights-reserved"] * 2, ["MIT"] * 2, ["MIT"] * 2, ["Apache-2.0"] * 2, ["BSD"] * 2, ["MIT"] * 3, ["MIT"]]
    for i in (3, 4, 7):
        assert all(texts[i][x.start : x.end].startswith("Permission is") and texts[i][x.start : x.end].endswith("IN THE SOFTWARE") for x in got[i])


def test_copies_among_random_words(spark):
    rng = random.Random(16)
    long = ("MIT", "Apache-2.0", "BSD-3-Clause", "Zlib")
    for _ in range(12):
        name, copies = rng.choice(long), rng.randrange(1, 6)
        words = licenses.TEMPLATES[name].split()
        text = []
        for _ in range(copies):
            text += rng.choices(WORDS, k=rng.choice((0, 3, 40, 300)))
            text += [w if rng.random() > 0.05 or "/" in w or w.lower().strip('.,"') in licenses.TELLING else "edited" for w in words]
        text = " ".join(text + rng.choices(WORDS, k=20))
        found = licenses.find_licenses(text, licenses.Templates(licenses.TEMPLATES))
        assert [f[0] for f in found] == [name] * copies


def test_notices_are_aligned():
    known = licenses.Templates(licenses.TEMPLATES)
    kinds = lambda text: [f[0] for f in licenses.find_licenses(text, known)]
    assert kinds("a b c Released under the MIT License. foo bar Released under the MIT License. z") == ["MIT-notice"] * 2
    assert kinds("it is released under the terms of the MIT License") == ["MIT-notice"]
    assert kinds("Licensed under CC BY-NC-ND 4.0, not CC BY 3.0. Licensed under the Apache License, Version 1.1.") == ["CC-BY-NC-ND-4.0-notice"]
    assert kinds("This work is licensed under the GNU Lesser General Public License, version 3") == ["LGPL-3.0-notice"]
    assert [kinds(f"x {licenses.TEMPLATES[n]} y") for n in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL", "AGPL-3.0")] == [["BSD-2-Clause"], ["BSD-3-Clause"], ["GPL-2.0"], ["GPL"], ["AGPL-3.0"]]


# --- 7 ---------------------------------------------------------------------------


def plain_smith_waterman(a, b):
    h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_plain_form():
    rng = random.Random(7)
    for _ in range(150):
        a, b = (np.array(rng.choices(range(5), k=rng.randrange(1, 14)), np.uint64) for _ in range(2))
        score, matches, first, last = decontam.smith_waterman(a, b)
        assert score == plain_smith_waterman(a.tolist(), b.tolist())
        assert matches <= last - first


def test_leaks(spark):
    rng = random.Random(8)
    items = [" ".join(rng.choices(WORDS, k=30)) for _ in range(12)]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "..")], "item_id long, text string")
    filler = lambda n: " ".join(rng.choices(WORDS, k=n))
    edit = lambda t, k: " ".join("zz" if i % k == k - 1 else w for i, w in enumerate(t.split()))
    texts = [filler(80) + " " + items[0].upper() + ". " + filler(80), filler(40) + " " + edit(items[1], 6), filler(20) + " " + " ".join(items[2].split()[5:27]), " ".join(items[3].split()[:5]), filler(500), None, "", items[4], *[f"{i} {items[5]} {i}" for i in range(50)]]
    df = docs(spark, texts).withColumn("item_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (7, 4), *[(8 + i, 5) for i in range(50)]}  # a passage in many documents still has seeds
    assert {r.doc_id for r in decontam.uncontaminated(df, bench).collect()} == {3, 4, 5, 6}
    assert decontam.leaks(df.limit(0), bench).count() == decontam.leaks(df, bench.limit(0)).count() == 0


def test_edited_leaks_beside_verbatim_copies(spark):
    rng = random.Random(9)
    item = " ".join(rng.sample(WORDS, 30))
    filler = lambda: " ".join(f"f{rng.randrange(900)}" for _ in range(60))
    edit = lambda k: " ".join("zz" if i % k == k - 1 else w for i, w in enumerate(item.split()))
    texts = [item, *[f"{filler()} {edit(k)} {filler()}" for k in (3, 4, 5)], f"{filler()} " + " zz ".join(item.split()), filler()]
    got = {r.doc_id: r.similarity for r in decontam.leaks(docs(spark, texts), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}
    assert {i: round(s, 3) for i, s in got.items()} == {0: 1.0, 1: 0.517, 2: 0.65, 3: 0.717, 4: 0.517}


def test_short_items_in_many_documents(spark):
    items = ["alpha", "beta gamma", "delta eps zeta", "u1 u2 u3 u4 u5 u6"]
    texts = [f"f{i} g{i} {t} h{i} k{i}" for i in range(6) for t in ("alpha", "beta gamma", "delta eps zeta", "u1 u2 u3", "x y")]
    got = decontam.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in got} == {(5 * i + k, k, 0.5 if k == 3 else 1.0) for i in range(6) for k in range(4)}


def test_screen_loses_nothing():
    rng = random.Random(10)
    for _ in range(400):
        item = [f"w{rng.randrange(rng.choice((4, 30)))}" for _ in range(rng.randrange(1, 14))]
        text = rng.choices(WORDS[:40], k=rng.randrange(1, 9))
        for w in item:
            kind = rng.random()
            text += [] if kind < 0.15 else ["x"] if kind < 0.35 else [w]
            text += ["y"] if rng.random() < 0.3 else []
        hashes, long_match = decontam.words_of(" ".join(text))[0], rng.choice((4, 6, 40))
        screen = decontam.Screen([0], [" ".join(item)], 0.5, long_match)
        score, matches, _, _ = decontam.smith_waterman(hashes, screen.words[0])
        assert bool(list(decontam.aligned(screen, hashes))) == (score >= len(item) or matches >= long_match)


def brute_leaks(texts, items):
    """Documents and items of which the best alignment counts, by the plain form."""
    known = {}
    plain = lambda t: ["".join(c for c in w) for w in re.findall("[a-z0-9]+", t.lower())]
    number = lambda t: [known.setdefault(w, len(known)) for w in plain(t)]
    return {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t and plain_smith_waterman(number(t), number(x)) >= len(number(x))}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(17)
    few = WORDS[:60]
    items = [" ".join(rng.choices(few, k=rng.randrange(2, 14))) for _ in range(8)]
    texts = [" ".join(rng.choices(few, k=rng.randrange(40)) + [w for w in rng.choice(items).split() if rng.random() > 0.2] + rng.choices(few, k=rng.randrange(20))) for _ in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == brute_leaks(texts, items)


def test_long_texts_that_repeat_an_item():
    item = " ".join(f"w{i}" for i in range(60))
    text = " ".join(item if i % 3 else "q " * 20 for i in range(3000))
    screen = decontam.Screen([0], [item], 0.5, 40)
    found = list(decontam.aligned(screen, decontam.words_of(text)[0]))
    assert len(found) == 2000
    assert all((f[1], f[2], f[4] - f[3]) == (1.0, 60, 60) for f in found)
    assert len({f[3] for f in found}) == 2000


@pytest.mark.parametrize("length", [12, 50])
def test_thousands_of_items_in_one_document(length):
    """Every item is found once, at its place, in a time that grows with the text."""
    rng, taken = random.Random(20), {}
    for n in (1_000, 4_000):
        items = [" ".join(f"w{rng.randrange(40_000)}" for _ in range(length)) for _ in range(n)]
        screen = decontam.Screen(list(range(n)), items, 0.5, 40)
        hashes = decontam.words_of(" ".join(items))[0]
        since = time.perf_counter()
        found = sorted((f[3], f[0], f[4] - f[3]) for f in decontam.aligned(screen, hashes) if f[1] == 1.0)
        taken[n] = time.perf_counter() - since
        assert found == [(length * i, i, length) for i in range(n)]
    assert taken[4_000] < 30
    assert taken[4_000] < 10 * taken[1_000]


def test_common_spans_equal_plain_counts():
    rng = random.Random(21)
    for _ in range(60):
        item = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(5, 12))]
        text = [f"w{rng.randrange(14)}" for _ in range(120)]
        screen = decontam.Screen([0], [" ".join(item)], 0.5, 5)
        hashes = decontam.words_of(" ".join(text))[0]
        word = np.minimum(np.searchsorted(screen.known, hashes), len(screen.known) - 1)
        word[screen.known[word] != hashes] = len(screen.known)
        places = np.argsort(word, kind="stable")
        c, starts = 3 * len(item), set()
        for a, b in screen._common(word[places], places, 0):
            starts |= set(range(a, b - c + 1))
        assert starts == {s for s in range(120) if (Counter(text[s : s + c]) & Counter(item)).total() >= 5}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "one two three four"), (None, "none")], "doc_id string, text string")
    assert [tuple(r)[:2] for r in decontam.leaks(df, spark.createDataFrame([("x", "two three four")], "item_id string, text string")).collect()] == [("a", "x")]


# --- 8 ---------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(d, langid.fit(d.where(~langid.held_out()))).where(langid.held_out() & F.col("lang").isNotNull() & (F.length("text") >= 40)).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_edges(spark):
    train = docs(spark, ["the cat sat on the mat and the dog ran"] * 3).unionByName(docs(spark, ["der hund und die katze sind auf der matte"] * 3, "de")).unionByName(docs(spark, ["x"], None))
    model = langid.fit(train)
    assert set(model.dictionaries) == {"en", "de"}
    df = docs(spark, [None, "", "123 !! ²½ ³", "the cat sat on the mat and the dog", "die katze " * 20000]).withColumn("score", F.lit("clash"))
    got = [r.lang_pred for r in langid.predict(df, model).orderBy("doc_id").collect()]
    assert got == ["und", "und", "und", "en", "de"]
    assert langid.predict(df.limit(0), model).count() == 0
    assert langid.fit(train.limit(0)).dictionaries == {}
    assert langid.accepted(df.drop("score"), train).columns == train.columns


def test_narrow_margins_are_rejected(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(18)
    model = langid.fit(d.where(~langid.held_out() & F.col("lang").isin("en", "de")))
    other = langid.predict(d.where("lang in ('fr', 'es') and length(text) > 100"), model)
    assert other.where("rejected").count() >= 0.9 * other.count()
    own = langid.predict(d.where(langid.held_out() & F.col("lang").isin("en", "de") & (F.length("text") > 100)), model)
    assert own.where("rejected").count() <= 0.02 * own.count()
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(600)) for _ in range(50)]
    assert langid.predict(docs(spark, junk), model).where("rejected").count() >= 45


def test_many_languages_and_marks(spark):
    rng = random.Random(19)
    speech = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)] for k in range(70)}
    train = [(100 * k + i, " ".join(rng.choices(w, k=40)), lang, "s", 0) for k, (lang, w) in enumerate(speech.items()) for i in range(3)]
    model = langid.fit(spark.createDataFrame(train, DOC))
    assert set(model.dictionaries) == set(speech)
    said = langid.predict(docs(spark, [" ".join(rng.choices(w, k=30)) for w in speech.values()]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in said] == list(speech)
    assert langid.words("नमस्ते ²½ a1b2 e\u0301t") == ["नमस्ते", "a", "b", "e\u0301t"]


# --- 9 ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="home"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice"><p>We use cookies, a long notice about cookies that nobody reads at all.</p></div>
<div id=main class='content post-{n}'><h1>Title {n}</h1><p>First   <b>par</b>agraph &amp; more &#233; text that goes on.<p>Second paragraph<br>with a break.
<ul><li>one<li>two</ul><div class="ad">Buy now</div><section id="comments"><p>Reader says something quite long in the comments.</p></section></div>
<aside><p>Aside text</p></aside><form><input name=q>Search</form><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_a_page(spark):
    pages = [(i, f"http://www.host{i % 2}.org/a", PAGE.replace("{n}", str(i)), 1) for i in range(6)] + [(10, None, None, 1), (11, "http://host0.org/b", "", 1), (12, "odd", "<p>plain & simple", 1), (13, "http://host0.org/c", "<div><p>other <b>shape</div>", 1), (14, "http://h.org", "<" * 5000 + "<p>" * 3000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in htmltext.main_texts(df).collect()}
    for i in range(6):
        assert got[i].text == f"Title {i} First paragraph & more é text that goes on. Second paragraph with a break. one two"
        assert got[i].n_chars == len(got[i].text)
    assert got[10].text == got[11].text == ""
    assert got[12].text == "plain & simple"
    assert got[13].text == "other shape"
    assert htmltext.main_texts(df.limit(0)).count() == 0


def test_host_vote_wins_over_a_page(spark):
    good = "<html><body><div class='story'><p>" + "good text here. " * 20 + "</p></div><div class='extra'><p>small</p></div></body></html>"
    odd = "<html><body><div class='story'><p>short story.</p></div><div class='extra'><p>" + "much longer extra. " * 50 + "</p></div></body></html>"
    df = spark.createDataFrame([*[(i, "http://h.org/", good) for i in range(5)], (9, "http://h.org/", odd)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.main_texts(df).collect()}[9] == "short story."


def test_boxes_of_paragraphs_and_qualified_names():
    boxed = "<body><div class='story has-sidebar'><h1>Head</h1>" + "".join(f"<div class=para>Paragraph {i} with some words.</div>" for i in range(4)) + "</div><div class='sidebar'><div>x</div></div></body>"
    text = htmltext.Page(boxed).main_text([])
    assert text.startswith("Head Paragraph 0")
    assert text.endswith("Paragraph 3 with some words.")


def test_expressions_equal_the_page_form(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.main_texts(table).collect()}
    for r in table.collect():
        m = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)
        import html as h

        assert got[r.page_id] == " ".join(h.unescape(re.sub(r"<[^>]+>", " ", m[1])).split())


def test_every_path_of_a_host_is_known(spark):
    """Four families of pages on one host; each has a page with a longer box of its own."""
    page = lambda k, odd: f"<body><div class='fam{'abcd'[k]}x'><p>{'main text here. ' * 12}</p></div><div class='odd{odd}'><p>{'own text. ' * (30 if odd else 1)}</p></div></body>"
    rows = [(10 * k + i, "http://h.org/", page(k, "wxyz"[k] if i == 3 else "")) for k in range(4) for i in range(4)]
    got = {r.page_id: r.text for r in htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t.startswith("main text here.") and "own" not in t for t in got.values())


@pytest.mark.parametrize("source", ["<a " * 350_000, "<div>" * 100_000 + "deep", "<div>x" * 100_000, "<i>" * 50_000 + "</b>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<h1>" * 50_000, "<a x='>'" * 50_000, "</x>" * 50_000, "<![CDATA[" * 50_000, "<p class=\"" * 50_000])
def test_long_pages_take_linear_time(source):
    began = time.process_time()
    page = htmltext.Page(source)
    page.tree()
    page.main_text([])
    assert time.process_time() - began < 20


# --- 10 --------------------------------------------------------------------------


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 10, (2000, 4)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(float)
    model = pii.BoostedTrees().fit(x[:1500], y[:1500], np.ones(1500))
    assert ((model.probability(x[1500:]) > 0.5) == (y[1500:] > 0)).mean() > 0.97


def test_personal_data_base_spans_stay(spark):
    texts = ["mail a.b+c@x-y.example.com, call +1 (017) 555-7713 or 4111 1111 1111 1111", "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5", None, "", "é 4111111111111112 é", "x@y", "9" * 6000, "clean text 12 34", "+49 30 1234567 a@b.c"] * 3
    df = docs(spark, texts).withColumn("findings", F.lit(1))
    model = pii.fit(df)
    got = pii.digest(pii.find(df, model), pii.KINDS, tuple(pii.BASE), lambda x: x["base"]).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got[:9]] == [(1, 0, 1, 1), (0, 2, 0, 0), (0,) * 4, (0,) * 4, (0,) * 4, (0,) * 4, (0,) * 4, (0,) * 4, (1, 0, 0, 1)]
    clean = pii.redact(docs(spark, texts), model).orderBy("doc_id").collect()
    assert clean[0].text == "mail [EMAIL], call [PHONE] or [CARD]"
    assert clean[0].n_chars == len(clean[0].text)
    assert clean[2].text is None
    assert clean[7].text == "clean text 12 34"
    assert pii.find(df.limit(0), model).count() == 0
    assert pii.fit(df.limit(0)).trees is None


def test_loose_forms_are_learned(spark):
    rng = random.Random(11)
    forms = (lambda n: f"write to joe{n} (at) site{n % 7} (dot) com soon", lambda n: f"well (030) {n % 9000 + 1000}-5678 there", lambda n: f"and 555-123-{n % 9000 + 1000} too", lambda n: f"part 123-4567-{n % 90000 + 10000} is", lambda n: f"meet us{n} @ noon . There is")
    model = pii.fit(docs(spark, [forms[i % 5](rng.randrange(10**6)) for i in range(2000)] + ["a@b.com or +1 (017) 555-7713"] * 50))
    found = lambda text: [(k, text[s:e]) for k, s, e in model.spans(text)]
    assert found("see john (at) example (dot) com now") == [("email", "john (at) example (dot) com")]
    assert found("well (030) 1234-5678 now") == [("phone", "(030) 1234-5678")]
    assert found("and 555-123-4567 now") == [("phone", "555-123-4567")]
    assert found("part 123-4567-89012 is") == found("meet us @ noon . There is") == []


def test_rare_loose_forms_are_reached(spark):
    texts = [" ".join(f"a{k}@b.com" for k in range(60)) + f" joe{i} (at) site (dot) org" for i in range(200)] + [f"us{i} @ noon . There" for i in range(50)]
    model = pii.fit(docs(spark, texts))
    assert [k for k, _, _ in model.spans("see john (at) example (dot) com now")] == ["email"]


def brute_personal(text):
    """Base spans by the plain definition, one expression and check for each kind."""
    plain, out = text or "", []
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d[::-1])) % 10 == 0
    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    for k, (kind, pattern, ok) in enumerate(checks):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, plain) if ok(m[0])]
    out.sort()
    return hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, kind, e in out).encode()).hexdigest()


def test_personal_data_equals_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    got = pii.op10_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    assert all(r.base_sha256 == brute_personal(texts[r.doc_id]) for r in got)


def test_planted_forms_are_found_and_decoys_left_alone(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 20")
    model = pii.fit(d.where(~langid.held_out()))
    texts = [r.text for r in d.where(langid.held_out()).orderBy("doc_id").limit(200).collect()]
    rng = random.Random(20)
    right = wrong = wanted = 0
    for _ in range(1500):
        kind, genuine = rng.choice(pii.KINDS), rng.random() < 0.5
        whole, start, end = pii.piece(rng, rng.choice(texts), kind, genuine)
        base = pii.base_spans(whole)
        if not pii.apart(pii.merged(base), start, end):
            continue
        added = [c for c in model.spans(whole) if c not in base and c[1] < end and start < c[2]]
        wanted += genuine
        right += genuine and any(c[0] == kind for c in added)
        wrong += not genuine and bool(added)
    assert right >= 0.8 * wanted
    assert wrong <= 0.03 * (right + wrong)


def test_thresholds_come_from_all_held_out_candidates(spark, monkeypatch):
    """A sample of few candidates for the trees leaves none out where thresholds are chosen."""
    monkeypatch.setattr(pii, "SAMPLE_CANDIDATES", 40)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0").select("doc_id", "text")
    forms = (lambda i: f"write to anna.{i} (at) site{i} (dot) com today", lambda i: f"call me on (212) 555-{i + 1000} or later", lambda i: f"order 0{i % 80 + 10}-{i % 700 + 100}-{i + 10000} came")
    d = d.union(spark.createDataFrame([(10**6 + i, forms[i % 3](i)) for i in range(1_500)], "doc_id long, text string"))
    counts, asked = {}, pii.held_counts
    monkeypatch.setattr(pii, "held_counts", lambda texts, trees, least: counts.update(asked(texts, trees, least)) or counts.copy())
    model = pii.fit(d)
    texts = [r.text for r in d.where(F.expr("pmod(xxhash64(doc_id, text, 4), 4) = 0")).collect()]
    own = {kind: [] for kind in pii.KINDS}
    for t in texts:
        for c, base in pii.eligible(t):
            if not base:
                own[c[0]].append((model.trees.probability(np.array([pii.features(t, *c)], float))[0], pii.plausible(t, *c)))
    assert counts and sum(n.sum() for _, _, n in counts.values()) > 40
    for kind, (p, right, n) in counts.items():
        from_on = [x for x in own[kind] if x[0] >= p.min()] if len(p) else []
        assert (n.sum(), right.sum()) == (len(from_on), sum(sound for _, sound in from_on))
        chosen = [sound for q, sound in own[kind] if q >= model.thresholds.get(kind, 2)]
        assert n.sum() < pii.LEAST_SELECTED or not chosen or sum(chosen) >= pii.PRECISION * len(chosen)


def test_a_threshold_of_counts_is_that_of_rows():
    rng = np.random.default_rng(8)
    for _ in range(50):
        step = rng.integers(40, 64, 300) / 64
        y = (rng.random(300) < 0.9 + step / 10).astype(int)
        p = np.unique(step)
        assert pii.lowest_threshold(p, np.array([y[step == q].sum() for q in p]), np.array([(step == q).sum() for q in p])) == pii.lowest_threshold(step, y)


def test_many_spans_take_linear_time(spark):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    began = time.process_time()
    assert len(model.spans("a@b.co 10.0.0.1 joe (at) site (dot) com " * 20_000)) >= 40_000
    assert time.process_time() - began < 30
