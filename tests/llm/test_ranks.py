"""Chat formatting, ranked search and whitening against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from shelfmark.llm import chat, ranking, whitening

SF = "/root/testdata/sf0.001"


def read_by_hand(rows):
    groups, out = collections.defaultdict(list), {}
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def as_read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_read(chat.digest(spark, SF)) == read_by_hand(rows + chat.PLANTED)


def test_chat_windows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    rnd = random.Random(1)
    bits = ["a", "</s>", "[INST]", "\\", "<\\s>", " [/INST]\n", "é", "word " * 5, "<s", "[/"]
    text = lambda n: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, n)))
    rows = [(None, None, None, None), (1, None, "user", "x"), (1, None, "user", "x"), (2, 0, "system", "S " * 2000), (2, 1, "user", "u"), (3, 0, "system", "only"), (4, 5, "assistant", None)]
    rows += [(7, k, "system" if k == 0 else rnd.choice(["user", "assistant"]), text(30)) for k in range(400)] + [(8, k, rnd.choice(["user", "assistant"]), text(200)) for k in range(100)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, conv string, seg int")
    made = chat.format_conversations(df, budget=200, history=60)
    windows = made.collect()
    assert as_read(chat.read_back(made)) == read_by_hand(rows)
    long = sorted((w for w in windows if w.conv_id == 7), key=lambda w: (w.segment, w.window))
    assert len({w.segment for w in long}) > 10 and all(chat.parse(w.text)[0][0] == "system" for w in long)
    assert all(w.n_tokens <= 200 for w in long if not w.over_budget) and sum(w.n_repeated > 1 for w in long) > len(long) / 3
    turns = [(r, t) for _, _, r, t in sorted(r for r in rows if r[0] == 7)]
    for w in long[1:]:  # what is repeated are the turns right before the first new one
        said = chat.parse(w.text)
        assert said[1:] == turns[w.first_turn - w.n_repeated + 1 : w.first_turn + len(said) - w.n_repeated]
    one = [w for w in windows if w.over_budget]
    assert all(len(chat.parse(w.text)) - w.n_repeated == 1 for w in one)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("budget,history", [(10, 0), (10, 5), (30, 12)])
def test_choose(budget, history):
    rnd = random.Random(budget)
    for system in (0, 4):
        tokens = [rnd.randint(1, 14) for _ in range(200)]
        spans = list(chat.choose(tokens, system, 3, budget, history))
        assert [a for _, a, _ in spans] == [3, *[e for _, _, e in spans[:-1]]] and spans[-1][2] == len(tokens)
        for old, at, end in spans:
            n = system + sum(tokens[old:end])
            assert sum(tokens[old:at]) <= history and (n <= budget or end == at + 1)
            assert end == len(tokens) or n + tokens[end] > budget


def ranked_by_hand(items, docs):
    found = [(i, collections.Counter(t), len(t)) for i, t in ((i, ranking.terms_of(t)) for i, t in docs) if t]
    n, total, df = len(found), sum(f[2] for f in found), collections.Counter()
    for f in found:
        df.update(f[1].keys())
    out = []
    for i, text in items:
        scores = []
        for doc, tf, length in found:
            m = 100 - 75 + (75 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in ranking.terms_of(text) if tf[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(i, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=repr)


def ranks(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("slice_terms,cluster", [(1 << 14, 64), (200, 3)])
def test_ranking(spark, slice_terms, cluster):
    items, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "documents"))
    want = ranked_by_hand([(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    assert ranks(ranking.rank_documents(items, docs, slice_terms=slice_terms, cluster=cluster)) == want


def test_ranking_odd_rows(spark):
    texts = ["a b c", "A B ü", None, "", " .,; ", "ü Ü", "a a a b", "a a a b", "long " * 3000 + "c", "Éa éa c9"]
    docs = [(k if k != 1 else None, t) for k, t in enumerate(texts)] + [(6, "a a a b")] * 15
    items = [(1, "a b b ü c"), (1, "c9 é Éa"), (2, None), (3, "..."), (None, "LONG ü"), (4, "nowhere")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item int, score string")
    i = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, rank int, doc_id string")
    assert ranks(ranking.rank_documents(i, d, cluster=2)) == ranked_by_hand(items, docs)
    assert ranking.rank_documents(i.limit(0), d).count() == 0 and ranking.rank_documents(i, d.limit(0)).count() == 0


def test_skipping_is_exact():
    rnd = np.random.default_rng(3)
    shard = ranking.Shard.__new__(ranking.Shard)
    topic = rnd.integers(0, 8, 600)
    pairs = [(d, t) for d in range(600) for t in np.unique(np.concatenate([rnd.integers(0, 6, 3), 6 + topic[d] * 9 + rnd.integers(0, 9, 6)]))]
    shard.ids, shard.lens = np.arange(600), np.full(600, 20)
    shard.rows, shard.terms = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.int32)
    shard.counts = rnd.integers(1, 4, len(pairs)).astype(np.int32)
    weights = np.concatenate([np.full(6, 100), rnd.integers(2000, 6000, 72)])
    queries = [(np.sort(np.array([0, 1, *(6 + k * 9 + np.arange(9))])), None) for k in range(8)]
    needed = [np.unique(np.concatenate([q for q, _ in queries if t in q] or [np.empty(0, np.int64)])).astype(np.int64) for t in range(78)]
    blocks, scored = ranking.Blocks(shard, ranking.impacts(shard, 600, 12000), needed, weights, 16), 0
    for terms, _ in queries:
        best = ranking.Best()
        scored += ranking.search(blocks, terms, weights[terms], needed, best)
        full = blocks.dense[:, terms].astype(np.int64) @ weights[terms]
        order = np.lexsort((shard.ids, -full))[:10]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == full[order].tolist()
    assert scored < 0.5 * 8 * 600


def whitened_by_hand(rows):
    sound = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in sound})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in distinct])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:4]
    out = []
    for i, x in sound:
        white = [float((np.array(x) - np.array(sums) / n) @ axes[:, k] / math.sqrt(values[k])) for k in order]
        out.append((i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), white, (values[order] / values.sum()).tolist()))
    return out


def test_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    copies = spark.createDataFrame([(9_000_000 + k, rows[0][1]) for k in range(300)] + [(9_100_000, None), (9_100_001, [None] * 64), (9_100_002, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(dict)
    for r in whitening.whiten(table.select("vec_id", "embedding").unionByName(copies)).collect():
        got[r.id][r.component] = r
    want = whitened_by_hand(rows + [(9_000_000 + k, rows[0][1]) for k in range(300)])
    assert len(got) == len(want)
    sign = [np.sign(sum(w[3][k] * got[w[0]][k + 1].whitened for w in want)) for k in range(4)]
    for i, n, deviation, white, share in want:
        for k in range(4):
            r = got[i][k + 1]
            assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened - sign[k] * white[k]) < 1e-8
            assert abs(r.explained - share[k]) < 1e-9 and r.identity_error < 1e-9


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, float("nan")]), (2, None), (3, [None, 1.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [3.0, 4.5]), (5, [1.0]), (6, []), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "vec_id long, embedding array<double>, id int, idx string")
    got = sorted((r.id is None, r.component, abs(round(r.whitened, 9)), round(r.explained, 9), r.n) for r in whitening.whiten(df).collect())
    assert got == [(False, 1, 1.0, 1.0, 2)] * 2 + [(False, 2, 0.0, 0.0, 2)] * 2 + [(True, 1, 1.0, 1.0, 2), (True, 2, 0.0, 0.0, 2)]
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [3.0]), (2, [3.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.explained, r.identity_error) for r in one] == [(0.0, 0.0, 0.0)] * 2
    huge = whitening.whiten(spark.createDataFrame([(1, [3.0e15, 1.0]), (2, [-3.0e15, 2.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge)
