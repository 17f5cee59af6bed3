"""Turn repair, prefix trie and exact search against SQL and plain walks, on odd rows and hot groups."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from check import rows_of
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, topk_search, turn_repair
from tidemark.llm.queries import ORACLES, QUERIES

TURN = "conv_id long, turn long, role string, text string, place string, fault int, n int, level int, depth string"
LONG = " ".join(f"w{i % 977}." for i in range(40_000))


def odd_turns():
    rnd = random.Random(4)
    rows = [
        (None, 1, "user", "a."),
        (None, None, None, None),
        (1, None, "system", "s."),
        (1, None, "system", "s."),
        (1, 0, "user", ""),
        (1, 1, "", "odd role."),
        (1, 2, "tool", " \t"),
        (1, 2, "assistant", LONG),
        (2, 5, None, "x"),
        (3, 7, "user", None),
        (-7, 3, "user", "negative?"),
        (1 << 40, 2, "user", "far!"),
    ]
    for conv in range(40, 90):
        # families share starts, some turns repeat, some tie
        for turn in range(rnd.randrange(0, 14)):
            role = rnd.choice(["user", "assistant", "assistant", "user", "system", None])
            text = rnd.choice(["yes.", "no", "why?", "", "a b c!", f"t{rnd.randrange(4)}."])
            rows += [(conv, turn // rnd.choice([1, 1, 2]), role, text)] * rnd.choice([1, 1, 1, 2])
    return [(*r, "p", 1, 2, 3, "d") for r in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with odd conversations and vectors, extra columns named like inner ones."""
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_turns(), TURN).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    rnd = random.Random(1)
    vectors = [[rnd.gauss(0, 0.2) for _ in range(8)] for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i, vectors[3]) for i in range(200, 230)]
    rows += [(300, None), (301, [0.1, None] * 4), (350, [float("nan")] * 8), (400, [float("inf")] * 8), (450, [])]
    rows += [(None, vectors[5]), (500, [0.5] * 3), (550, [0.25] * 20), (501, vectors[0]), (501, vectors[0]), (501, vectors[1])]
    wide = [(i, v, 1, 2, 3, "k") for i, v in rows]
    spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, score int, rank int, shard string").repartition(
        4
    ).write.parquet(f"{folder}/embeddings.parquet")
    for name in ("conversations", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{folder}/empty/{name}.parquet")
    return folder


def told_by_sql(folder, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    result = con.execute(ORACLES[name])
    return rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_prefix_trie", "op13_topk_search"])
def test_odd_rows_agree_with_sql(spark, odd, name):
    got = QUERIES[name](spark, odd)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == told_by_sql(odd, name)
    assert QUERIES[name](spark, f"{odd}/empty").count() == 0


def walked(turns):
    """A plain walk over all edits: least cost, then least letters, by states after each prefix."""
    best = {0: (0, "")}

    def opened(states):
        for _ in range(2):
            for q, (c, s) in list(states.items()):
                to = {0: 2, 1: 2, 2: 3, 3: 2}[q]
                states[to] = min(states.get(to, (c + 6, "")), (c + 5, s + "I"))
        return states

    for initial, fault in turns:
        new = {}
        for q, (c, s) in opened(dict(best)).items():
            ways = [(2, "D", q)]
            if fault < 2:
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, q))
                ways += [(5 * fault, "K", kept)] if kept else []
                ways.append((1 + 5 * fault, "R", {0: 2, 1: 2, 2: 3, 3: 2}[q]))
            for cost, letter, to in ways:
                new[to] = min(new.get(to, (1 << 60, "")), (c + cost, s + letter))
        best = new
    ends = opened(best)
    return min(ends[q] for q in (0, 3) if q in ends)


@pytest.mark.parametrize("seed", range(6))
def test_runs_give_the_cost_of_single_turns(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        turns = [(rnd.choice(["s", "u", "a", ""]), rnd.choice([0, 0, 0, 1, 2])) for _ in range(rnd.randrange(1, 12))]
        turns = [t for t in turns for _ in range(rnd.choice([1, 1, 4]))]
        symbols = [(turn_repair._symbol(i, f), 1) for i, f in turns]
        runs = turn_repair.runs_of(symbols)
        m = turn_repair.transition(runs)
        assert min(m[0][j] + turn_repair.FINAL[j] for j in range(4)) == walked(turns)[0]
        done, state = turn_repair.unrolled(symbols, 0, turn_repair.FINAL)
        audit = "".join(x for _, x in done) + "I" * turn_repair.ENDS[state]
        assert audit == walked(turns)[1]


def test_a_long_conversation_is_read_in_parts(spark):
    """A third of all rows in one conversation, and a row repeated many times; any number of buckets gives the same."""
    rnd = random.Random(9)
    rows = [(1, i, rnd.choice(["user", "assistant"]), f"t{rnd.randrange(900)}" + rnd.choice([".", ""])) for i in range(900)]
    rows += [(2, 5, "user", "same.")] * 700 + [(3 + i, k, "ua"[k % 2], "x.") for i in range(200) for k in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    plain = turns.withColumn("copies", F.lit(1))

    def told(buckets):
        edits = turn_repair.repairs(plain, buckets)
        return {r.conv_id: r.asDict() for r in turn_repair.reports(turns, turn_repair.repaired(plain, edits)).collect()}

    few, many = told(2), told(50)
    assert few == many and len(few) == 202
    seen, shown = set(), []
    for _, _, role, text in rows[:900]:
        shown.append((role[0], 2 if (role, text) in seen else int(not text.endswith("."))))
        seen.add((role, text))
    assert (few[1]["cost"], few[1]["audit"]) == walked(shown)
    assert few[2]["duplicate"] == 699 and few[2]["audit"] == "D" * 700 and few[2]["cost"] == 1400
    assert few[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("width", [1, 3, 8])
def test_long_paths_continue_in_blocks(spark, width):
    rnd = random.Random(width)
    paths = {c: [rnd.randrange(2) for _ in range(rnd.choice([0, 1, 3, 30]))] for c in range(60)}
    paths.update({100 + c: [1] * 40 for c in range(40)})
    rows = [(c, i + 1, t, t + 10, t + 1) for c, path in paths.items() for i, t in enumerate(path)]
    rows += [(c, 0, None, None, None) for c, path in paths.items() if not path]
    frame = spark.createDataFrame(rows, "conv_id long, place int, h long, g long, words int")
    nodes = prefix_trie.with_kin(prefix_trie.prefix_trie(frame, width)).collect()
    want = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            want[tuple(path[:d])].append(c)
    below = {v: [u for u in want if u[: len(v)] == v] for v in want}
    childless = {u for u in want if len(below[u]) == 1}
    table = {
        (
            min(m),
            len(v),
            min(want[v[:-1]]) if v else None,
            len(m),
            sum(len(u) == len(v) + 1 for u in below[v]),
            sum(u in childless for u in below[v]),
            sum((len(want[u]) - 1) * (u[-1] + 1) for u in below[v] if u),
            hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(v)))).encode()).hexdigest(),
        )
        for v, m in want.items()
    }
    got = {
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_words, r.ends_sha256 or prefix_trie.EMPTY)
        for r in nodes
    }
    assert len(nodes) == len(want) and got == table


@pytest.mark.parametrize("shard_rows", [7, 64, 1 << 16])
def test_search_is_exact_in_any_shards(spark, monkeypatch, shard_rows):
    """Hot copies, ties and vectors near each other; a proof may only stop what cannot be among the best."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk_search, "MEMBERS", 5)
    rnd = random.Random(shard_rows)
    base = [[rnd.randrange(-90, 90) for _ in range(12)] for _ in range(150)]
    rows = base + [base[7]] * 75 + [[x + rnd.randrange(2) for x in base[9]] for _ in range(25)]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, v array<int>").repartition(2)
    wanted = [i for i in range(len(rows)) if i % 10 == 0]
    # the shards are built in the session's own process tree, so the patched sizes are sent along
    batches = frame.toArrow().to_batches()
    stored = spark.createDataFrame(
        [r for b in topk_parts(batches) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)], topk_search.STORED_TYPE
    )
    got = defaultdict(list)
    for r in topk_search.top_k(stored, frame.where("vec_id % 10 = 0"), 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in wanted:
        scores = sorted(((-sum(a * b for a, b in zip(rows[q], v, strict=True)), i) for i, v in enumerate(rows) if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def topk_parts(batches):
    """The index in this process, with the task number that Spark would give."""

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):
            return 0

    kept, topk_search.TaskContext = topk_search.TaskContext, Context
    try:
        return list(topk_search._indexed(iter(batches)))
    finally:
        topk_search.TaskContext = kept


def test_a_proof_stops_early():
    """With some vectors far ahead, the levels after the proof are not read."""
    rnd = random.Random(2)
    rows = [[rnd.randrange(-20, 20) for _ in range(16)] for _ in range(3000)] + [[100] * 16] * 8
    shard = topk_search.Shard()
    for b in topk_parts([topk_batch(rows)]):
        for _, kind, _, dim, impact, ids, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
            shard.add(kind, dim, impact, ids, body)
    shard.close()
    stop = shard.stops[7][0]
    shard.segments = shard.segments[:stop] + [None] * (len(shard.segments) - stop)  # reading on would fail
    weights = topk_search.np.array([[90] * 16], topk_search.np.int32)
    ((_, ids, scores),) = shard.best(topk_search.np.array([-5]), weights, 5)
    assert ids.tolist() == [3000, 3001, 3002, 3003, 3004] and scores.tolist() == [144_000] * 5


def topk_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["vec_id", "v"])


def test_words_hashed_over_buffers_are_told_apart(monkeypatch):
    """Bounds as split() has them, equal hashes for equal words only, also across steps of the buffer and in words longer than one."""
    from tidemark.llm import tokens

    rnd = random.Random(6)
    texts = ["", " a b  a\n", "\t\x0b\x0c\r", "é b ba aab", "x" * 5000 + " y " + "x" * 4999, "a"]
    texts += [" ".join("".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(200)) for _ in range(5)]
    texts = [t.encode() for t in texts]
    split = [t.split() for t in texts]
    for step in (7, 64, 1 << 20):
        monkeypatch.setattr(tokens, "PIECE_BYTES", step)
        hashes, ends = tokens.word_hashes(texts, tokens.Powers())
        assert ends.tolist() == [sum(map(len, split[:i])) for i in range(len(texts) + 1)]
        named = {}
        for word, h in zip((w for t in split for w in t), hashes.tolist(), strict=True):
            assert named.setdefault(word, h) == h
        assert len(set(named.values())) == len(named)
