import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import linear, op2_decontaminate, op3_quality, op7_mixing
from tessera.llm import text as tx
from tests.llm.test_operators import edited, jaccard, labels_of, lower, passages, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.3 * len(ids)
        docs, ids = out, kept
    assert "epoch" in docs.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql_of_queries(spark):
    import duckdb

    from tessera.llm import registry

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, SF)
        want = con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str), name


# --- the whole run against a plain program


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, whole string"


def small_tables():
    """Documents, labels and benchmark items with junk, copies, near copies, passages, nulls, repeated and long rows."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(20, 70))) + "." for _ in range(60)]
    items = passages(rng, 90, 3) + passages(rng, 40, 2)
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100 + k, " ".join(w.upper() + "!!" for w in t.split())) for k, t in enumerate(texts[:30])]  # junk
    rows += [(200 + k, texts[k].upper() if k % 2 else texts[k]) for k in range(8)]  # copies
    for k in range(10, 20):  # near copies and not so near ones
        ws = texts[k].split()
        for n in range(1 + k % 3):
            ws[5 + 11 * n if 5 + 11 * n < len(ws) else 0] = "changed"
        rows.append((300 + k, " ".join(ws)))
    for k in range(12):
        rows.append((400 + k, f"{texts[20 + k]} {edited(rng, items[k % 5], (k % 4) * 0.06, 3)} {word()}"))
    rows += [(500, None), (501, ""), (502, " \n\t "), (None, texts[40]), (None, texts[41] + " once"), (None, None), (503, "one"), (504, " ".join(word() for _ in range(9000)))]
    rows += [(41, texts[41]), (505, "twice here\n" + texts[42]), (505, "twice here\n" + texts[42]), (505, "another text " + texts[43])]
    place = lambda k: (["en", "de", None, "fr"][k % 4], [f"src{k % 5}", None, "web"][k % 3])
    docs = [(i, t, *place(k), len(t or ""), f"own {k}") for k, (i, t) in enumerate(rows)]
    labels = [(i, int(not 100 <= i < 200), 0) for i, _ in rows if i is not None and i < 200] + [(0, 1, 0), (None, 1, 0), (999, 1, 0), (3, None, 0)]
    return docs, labels, [(k, t) for k, t in enumerate(items)] + [(50, None), (51, "")]


def plain_quality(rows, labels):
    def features(t):
        row, bucket, value = op3_quality.sample_features(*tx.strings(pa.array([t], pa.string())))
        return dict(zip(bucket.tolist(), np.asarray(value, dtype=np.float32).astype(float).tolist(), strict=True)) | {1 << op3_quality.BITS: 1.0}

    marks = {}
    for i, q, _ in labels:
        if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            marks[i] = max(q, marks.get(i, 0))
    train = {}
    for i, t, *_ in rows:
        if i in marks:
            train.setdefault(i, t)
    xs = [(features(train[i]), marks[i]) for i in sorted(train)]
    alpha, l1, l2, epochs = (op3_quality._OPTIONS[k] for k in ("alpha", "l1", "l2", "epochs"))
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / alpha + l2)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(xs)):
            x, y = xs[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    score = lambda t: 1 / (1 + math.exp(-sum(weight(i) * v for i, v in features(t).items())))
    return [r for r in rows if score(r[1]) >= op3_quality.KEEP]


def plain_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r)
    return [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()]


def plain_near(rows):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingles(r[1]))
    root = labels_of(sorted(sets), lambda a, b: any(jaccard(x, y) >= 0.8 for x in sets[a] for y in sets[b]))
    return [r for r in rows if r[0] is None or root[r[0]] == r[0]]


def plain_clean(rows, items):
    def squeezed(t):
        return " ".join(lower(t).split())

    def least(item, t):
        masks = {}
        for k, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << k
        return op2_decontaminate.least_edits(masks, len(item), t)

    wanted = [squeezed(t) for _, t in items if t]
    return [r for r in rows if all(least(x, squeezed(r[1])) > op2_decontaminate.allowed(len(x)) for x in wanted)]


def plain_mix(rows):
    def leaf(r):
        source = r[3] or ""
        tail = source[len(source.rstrip("0123456789")) :]
        return (f"d{int(tail) % 3 if tail else 0}", r[2] or "", source)

    def poured(children, budget):
        """children: key -> (cap, weight). What a short child leaves goes to the others, by weight."""
        out, live = {}, {k for k, (_, w) in children.items() if w > 0}
        left = budget
        while live:
            level = left / sum(children[k][1] for k in live)
            short = {k for k in live if children[k][0] / children[k][1] <= level}
            if not short:
                out |= {k: math.floor(children[k][1] * level) for k in live}
                break
            for k in short:
                out[k] = children[k][0]
                left -= children[k][0]
            live -= short
        return {k: out.get(k, 0) for k in children}

    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += len((r[1] or "").split())
    for r in rows:
        tokens[leaf(r)] += 0
    budget = {(): math.floor(sum(tokens.values()) * op7_mixing.SHARE)}
    for depth in (1, 2, 3):
        nodes = {}
        for k, n in tokens.items():
            nodes[k[:depth]] = nodes.get(k[:depth], 0) + n * op7_mixing.EPOCHS
        new = {}
        for parent, b in budget.items():
            new |= poured({k: (c, op7_mixing.WEIGHTS.get("/".join(k), op7_mixing.DEFAULT_WEIGHT)) for k, c in nodes.items() if k[:-1] == parent}, b)
        budget = new
    out = []
    for k, alloc in budget.items():
        total = tokens[k]
        whole = alloc // total if total else 0
        rest = alloc - whole * total
        own = [r for r in rows if leaf(r) == k]
        out += [(*r, e) for r in own for e in range(whole)]
        where = lambda r, e=whole: int(hashlib.md5(f"{op7_mixing.SEED}:{e}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)
        for r in own:
            run = sum(len((x[1] or "").split()) for x in own if where(x) <= where(r))
            if rest > 0 and run <= rest:
                out.append((*r, whole))
    return out


def test_run_equals_a_plain_program(spark, tmp_path):
    import corpus_pipeline as cp

    docs, labels, items = small_tables()
    for name, rows, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    key = lambda rows: sorted(map(str, rows))
    now, df = docs, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), plain in zip(cp.STAGES, (lambda r: plain_quality(r, labels), plain_exact, plain_near, lambda r: plain_clean(r, items), plain_mix), strict=True):
        before, now = len(now), plain(now)
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"after-{name}"))
        df = spark.read.parquet(str(tmp_path / f"after-{name}"))
        if name == "exact":  # which of rows that share id and text stays isn't defined
            now = [(*r[:2], *r[2:]) for r in now]
            assert key((r["doc_id"], lower(r["text"])) for r in df.collect()) == key((r[0], lower(r[1])) for r in now)
            now = [tuple(r) for r in df.collect()]
        assert key(tuple(r) for r in df.collect()) == key(now), name
        assert 0 < len(now) < before or name == "mix"
    whole = cp.run(spark, str(tmp_path))
    assert whole.columns == [*df.columns]
    assert key((r["doc_id"], lower(r["text"]), r["epoch"]) for r in whole.collect()) == key((r[0], lower(r[1]), r[-1]) for r in now)


def test_run_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    docs, labels, items = small_tables()
    for name, rows, schema in (("documents", [], COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert linear.SAMPLE >= len(labels)
