"""Whitening, line dedup and conversation repair against brute force and awkward rows."""

import hashlib
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dbpulse.llm import conversation_repair as cr
from dbpulse.llm import line_dedup, queries, whitening
from tests.compare import SF

# ---- 11 whitening -------------------------------------------------------------------


def brute_whitening(vectors):
    """Exact sums by fractions, the plain covariance of centred products, numpy's decomposition."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dims)]
    z = [[n * r[i] - s[i] for i in range(dims)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(v)
    return [sum(a * a for a in r) for r in z], np.array([[a / n for a in r] for r in z]), values[::-1], vectors[:, ::-1], np.trace(v)


def check_whitening(rows, vectors, ids):
    deviation, centred, values, directions, trace = brute_whitening(vectors)
    many = min(8, len(values))
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert len(rows) == len(vectors) * many
    for c in range(many):
        want = centred @ directions[:, c] / np.sqrt(values[c])
        have = np.array([got[i, c + 1][0].whitened for i in ids])
        assert np.allclose(want, have, atol=1e-7) or np.allclose(want, -have, atol=1e-7)
        for i, d in zip(ids, deviation):
            assert {x.deviation for x in got[i, c + 1]} == {d}
            assert {x.n for x in got[i, c + 1]} == {len(vectors)}
            assert abs(got[i, c + 1][0].explained - values[c] / trace) < 1e-9
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-4


def test_whitening_query_is_brute_force(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    keep = [r for r in given if r.embedding is not None and all(e is not None and math.isfinite(e) for e in r.embedding)]
    check_whitening(queries.op11_whitening(spark, SF).collect(), [r.embedding for r in keep], [r.vec_id for r in keep])


def test_whitening_of_broken_far_and_repeated_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_AT_ONCE", 7)
    r = random.Random(1)
    good = [[r.gauss(0, 1) * (1 + j) for j in range(5)] for _ in range(40)]
    good[3] = [1e6, -1e6, 3.5, 0.0, -0.0]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(90, None, "x"), (91, [1.0, None, 0.0, 0.0, 0.0], "x"), (92, [math.nan] * 5, "x"), (93, [math.inf, 0.0, 0.0, 0.0, 0.0], "x"), (94, [], "x"), (95, [1.0, 2.0], "x"), (96, [1e300] * 5, "x")]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    check_whitening(whitening.whiten(made).collect(), good, list(range(40)))
    # a null id is an id like others, repeated rows count each
    twice = spark.createDataFrame([(None, v, "x") for v in good[:20]] + [(None, v, "x") for v in good[:20]], made.schema)
    assert {(x.n, x.vec_id) for x in whitening.whiten(twice).collect()} == {(40, None)}


def test_whitening_is_exact_beyond_64_bits(spark):
    # entries of 50 bits: squares need 100, sums of both dimensions more
    vectors = [[float(2**40 + 7 * i), float(-(2**39) + 3 * i * i)] for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    deviation, *_ = brute_whitening(vectors)
    assert {r.vec_id: int(r.deviation) for r in got.collect()} == dict(enumerate(deviation))
    model = whitening.fit(got.sparkSession.createDataFrame([([0, 1],), ([2**50, 5],)], "x array<bigint>"))
    assert model.trace == 2.0**98 + 4.0


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert {(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).collect()} == {(1, 0, None, None, None), (2, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")
    rows = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and rows[0].identity_error < 1e-9
    assert whitening.whiten(same.limit(0)).collect() == []
    assert whitening.whiten(same.limit(0)).columns == whitening.whiten(line).columns


# ---- 12 line dedup ------------------------------------------------------------------


def brute_lines(rows, min_chars, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or i == last[key(x)]]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10_000, 3])
def test_lines_are_brute_force(spark, monkeypatch, hot):
    """Repeated, null and clashing rows, blanks and letters at the edges of the key, with few and many broadcast hashes."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot)
    r = random.Random(2)
    lines = ["Shared line number %d" % k for k in range(12)] + ["  \tPADDED ünd ÉCOLE line\x0b", "padded ünd ÉCOLE line", "padded ünd école line", " padded ünd ÉCOLE line", "short", "", "\r"]
    rows = [(i, "\n".join(r.choices(lines, k=r.randrange(9)))) for i in range(60)]
    rows += [(7, rows[7][1]), (7, "\n".join(lines)), (None, "\n".join(lines)), (None, "\n".join(lines)), (None, None), (61, None), (62, ""), (63, "\n\n"), (64, "\n".join(lines * 300))]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_lines", F.lit(1)).withColumn("pos", F.lit(2))
    got = line_dedup.dedup_lines(made, min_chars=16, min_docs=5)
    assert got.columns == ["doc_id", "text", "N_lines_given", "pos", "n_lines", "n_dropped", "kept_text"]
    have = [(x.doc_id, x.n_lines, x.n_dropped, x.kept_text) for x in got.collect()]
    assert sorted(have, key=str) == brute_lines(rows, 16, 5)
    assert line_dedup.dedup_lines(made.limit(0)).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ---- 13 conversation repair ---------------------------------------------------------

GOOD = {(), *[tuple(p + "ua" * n) for p in ("", "s") for n in range(1, 6)]}


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_repair(rows):
    """All edits of each row with all insertions of up to two rows at each place, shortest conversations only."""
    faults, best = faults_of(rows), None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    name = {"u": "user", "a": "assistant"}

    def walk(i, cost, audit, kept):
        nonlocal best
        if best and cost > best[0]:
            return
        for ins in inserts:
            c, a, k = cost + 5 * len(ins), audit + "I" * len(ins), kept + [(name[x], "") for x in ins]
            if i == len(rows):
                if tuple(r[:1] or "?" for r, _ in k) in GOOD:
                    found = (c, a, "\n".join(f"{r}:{t}" for r, t in k))
                    best = min(best or found, found)
                continue
            role, text = rows[i]
            walk(i + 1, c + 2, a + "D", k)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                walk(i + 1, c + more, a + "K", k + [(role, text)])
                for new in ("user", "assistant"):
                    walk(i + 1, c + 1 + more, a + "R", k + [(new, text)])

    walk(0, 0, "", [])
    return best


def test_repair_is_brute_force(spark):
    """Random short conversations, blocks of one to many rows, so that conversations lie over several pieces."""
    r = random.Random(3)
    roles, texts = ["user", "assistant", "system", "unknown", "Sam", "tool", ""], ["Fine.", "Well!", "cut", " \n", "", "ok? \t", "más."]
    convs = {k: [(r.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.4 else f"{j} said {r.random()}.") for j in range(r.randrange(1, 6))] for k in range(120)}
    given = spark.createDataFrame([(k, j, a, b, 1) for k, v in convs.items() for j, (a, b) in enumerate(v)], "conv_id long, turn long, role string, text string, audit int")
    want = {}
    for k, rows in convs.items():
        cost, audit, said = brute_repair(rows)
        f = faults_of(rows)
        first = [role[:1] for role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        want[str(k)] = (0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    for block in (1, 3, 1024):
        got = {x.conv: tuple(x)[1:] for x in cr.digests(cr.repair(given, block=block)).collect()}
        assert got == want, block


def test_one_conversation_of_all_rows_goes_through_many_pieces(spark):
    r = random.Random(4)
    rows = [(None, j, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", f"{j}!"])) for j in range(3_000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = (cr.digests(cr.repair(given, block=b)).collect() for b in (10**6, 64))
    assert whole == cut and len(whole) == 1 and whole[0].conv == " "
    edits = cr.repair(given, block=64)
    assert edits.agg(F.sum("cost")).first()[0] == whole[0].cost and edits.count() == 3_000


def test_insertions_are_followed(monkeypatch):
    """With deletion dear, rows are inserted, at the end too."""
    monkeypatch.setattr(cr, "INSERT", 1)
    monkeypatch.setattr(cr, "ARCS", [[[(c + 50 * (x == 0), to) for x, (c, to) in enumerate(arcs)] for arcs in kind] for kind in cr.ARCS])
    cost = cr.COST.copy()
    cost[0] += 50
    monkeypatch.setattr(cr, "COST", cost)
    end = cr._with_inserts([0, cr.FAR, cr.FAR, 0])
    kinds = [1, 3, 2]  # s a u wants s [u] a u [a]
    letter, successor = cr.least_paths(kinds, cr.costs(kinds, end), True)
    assert "".join(cr.LETTERS[letter[n]] for n in cr.path(successor, 0)).strip() == "KIKKI"


def test_repair_of_awkward_turns(spark):
    """Null ids, turns, roles and texts, repeated rows and turns, long texts, an empty table."""
    long = "word " * 200_000 + "end."
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "assistant", "b."), (1, 2, "user", "a."), (1, 2, "user", "a."), (1, 9, "user", "a."), (2, 1, "user", long), (2, 2, "assistant", long), (2, 4, "assistant", None)]
    given = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("kind", F.lit("x")).withColumn("at", F.lit("y"))
    got = {x.conv: x for x in cr.digests(cr.repair(given)).collect()}
    assert tuple(got[" "])[1:8] == (0, 2, 0, 0, 1, 4, "DD")
    # b. | a. a. | a.: copies must go; what is left reads a u, and one of both goes with the other
    assert tuple(got["1"])[1:8] == (6, 0, 2, 0, 2, 6, "RRDD")
    assert (got["2"].gaps, got["2"].blank, got["2"].audit, got["2"].cost) == (1, 1, "KKD", 2)
    assert got["2"].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert cr.digests(cr.repair(given.limit(0))).count() == 0


def test_repair_query_keeps_conversations_of_which_no_row_is_left(spark, tmp_path):
    import zlib

    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
