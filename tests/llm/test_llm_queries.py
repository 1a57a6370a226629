"""The registered llm queries and the pipeline on the smallest tables."""

import bisect
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from conftest import SF0001
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import PII, SECRET, _base
from hirelake.llm import mixing, quality, simhash
from hirelake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF0001}/{t}.parquet'")
    out = QUERIES[name](spark, SF0001)
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(out.columns)
    assert Counter(res.fetchall()) == Counter(tuple(r) for r in out.select(cols).collect())


def test_pipeline_equals_its_steps_by_hand(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF0001}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{SF0001}/labels.parquet"))
    good = [i for i, s in zip(docs, model.score([d["text"] for d in docs.values()])) if s >= 0.3]
    fps = {i: simhash.simhash(docs[i]["text"]) for i in good}
    root = {i: i for i in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in good:
        for j in good:
            if ((fps[i] ^ fps[j]) & (2 ** 64 - 1)).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = sorted({find(i) for i in good})
    clean = _decontaminated({i: docs[i]["text"] for i in kept}, [r["text"] for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()])
    want = _mixed(spark, {i: (docs[i]["source"], t) for i, t in clean.items()})
    out = corpus_pipeline.run(spark, SF0001)
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == want
    assert any(clean[i] != docs[i]["text"] for i in clean) and len(clean) <= len(kept) < len(good) < len(docs)
    assert all((r["source"], r["lang"]) == (docs[r["doc_id"]]["source"], docs[r["doc_id"]]["lang"]) and len(r["text"]) == r["n_chars"] for r in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += len(r["text"].encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    where = defaultdict(set)
    for r in rows:
        where[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())   # equal texts stay together
    assert max(sizes.values()) <= max(sum(sizes.values()) / 40 * 1.05, max(n for n in Counter(
        {t: sum(len(r["text"].encode()) + 16 for r in rows if r["text"] == t) for t in where}).values()))


def _decontaminated(texts, benchmark, n=10):
    """Texts without the words of the benchmark's windows; those that are mostly such words are left out."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    windows = set()
    for t in benchmark:
        w = word.findall((t or "").translate(lower))
        windows |= {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    lengths, out = {len(x) for x in windows}, {}
    for i, t in texts.items():
        words, gaps = word.findall(t or ""), word.split(t or "")
        low, hit = [w.translate(lower) for w in words], set()
        for k in lengths:
            for at in range(len(low) - k + 1):
                if tuple(low[at:at + k]) in windows:
                    hit |= set(range(at, at + k))
        if not hit:
            out[i] = t
        elif len(hit) <= 0.5 * len(words):
            keep = [k for k in range(len(words)) if k not in hit]
            text = "".join((gaps[k] if m and keep[m - 1] == k - 1 else " ") + words[k] for m, k in enumerate(keep))
            out[i] = (text + (gaps[-1] if keep[-1] == len(words) - 1 else "")).strip(" ")
    return out


def _mixed(spark, rows):
    """The mix as documents."""
    taken, words = _taken(spark, rows)
    out = Counter()
    for i, n in taken.items():
        whole, rest = divmod(n, len(words[i]))
        out[(i, rows[i][1])] += whole
        if rest:
            out[(i, " ".join(words[i][:rest]))] += 1
    return +out


def _taken(spark, rows, slots=300_000):
    """Words taken of each row, slot by slot: a pointer into each source's shuffled stream of words."""
    frame = spark.createDataFrame([(i, t) for i, (_, t) in rows.items()], "doc_id long, text string")
    order = {r[0]: r[1] for r in frame.select("doc_id", F.xxhash64(F.lit("mix"), "doc_id", "text")).collect()}   # only the shuffle is Spark's
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, t) in rows.items()}
    sources = sorted({s for s, _ in rows.values()}, key=lambda s: (s is None, s or ""))
    streams = [[(i, k) for i in sorted((i for i in rows if rows[i][0] == s), key=lambda i: (order[i], len(words[i]))) for k in range(len(words[i]))] for s in sources]
    goal = mixing.targets([len(s) for s in streams], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sources))])
    edges, block = list(itertools.accumulate(goal)), max(1, math.ceil(sum(goal) / slots))
    left, taken = [round(g) for g in goal], Counter()
    places = [0] * len(sources)

    def slot(k):
        stream, size = streams[k], min(block, left[k])
        if not size or not stream:
            return
        start = places[k] % len(stream)
        size = min(size, len(stream) - start)
        for i, _ in stream[start:start + size]:
            taken[i] += 1
        places[k] += size
        left[k] -= size
    for position in range(math.ceil(sum(goal) / block)):
        slot(min(bisect.bisect_right(edges, math.modf((position + 0.5) * mixing.GOLDEN)[0] * edges[-1]), len(edges) - 1))
    for k in range(len(sources)):
        while left[k] and streams[k]:
            slot(k)
    return taken, words


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    empty = spark.read.parquet(f"{SF0001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF0001).columns == corpus_pipeline.COLUMNS


def test_op5_reads_every_document(spark):
    out = QUERIES["op5_fingerprints"](spark, SF0001).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    want = {}
    for k, i in enumerate(ids):
        t, n = docs[i], docs[ids[(k + 1) % len(ids)]]
        want[i] = hashlib.sha256((t[:len(t) - len(t) // 3] + n[:len(t) // 3]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in out} == want


def _docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}


@pytest.mark.parametrize("name, kinds", [("op1_pii", PII), ("op4_secrets", SECRET)])
def test_base_spans_of_the_queries(spark, name, kinds):
    docs = _docs(spark)
    rows = QUERIES[name](spark, SF0001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = _base(docs[r["doc_id"]]["text"] or "", kinds)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        spans = base.split(",") if base else []
        assert [r[f"n_{k}"] for k in kinds] == [sum(s.startswith(k + ":") for s in spans) for k in kinds]
        assert set(spans) <= set(r["spans"].split(","))


def test_op3(spark):
    docs = _docs(spark)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    frame = spark.read.parquet(f"{SF0001}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{SF0001}/labels.parquet"))
    score = dict(zip(docs, model.score([d["text"] for d in docs.values()])))
    rows = QUERIES["op3_quality"](spark, SF0001).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx(score) and len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)


def test_op7(spark):
    docs = _docs(spark)
    fps = {i: simhash.simhash(d["text"]) & (2 ** 64 - 1) for i, d in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(docs, 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    # the fingerprints themselves, bit by bit
    for i, d in list(docs.items())[:20]:
        words = re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"] or "").strip("\x20\t\n\x0b\x0c\r"))
        grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words != [""] else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert fps[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    rows = QUERIES["op7_simhash"](spark, SF0001).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", find(i)) for i in docs} and len(rows) == len(docs)


def test_op9(spark):
    docs = _docs(spark)
    rows = QUERIES["op9_sharding"](spark, SF0001).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for i, d in docs.items()} and len(rows) == len(docs)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)} and all(0 <= r["shard"] < 40 for r in rows)
    load, slots, group = Counter(), defaultdict(list), defaultdict(Counter)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        group[docs[r["doc_id"]]["text"]][r["shard"]] += r["size"]
    assert all(len(g) == 1 for g in group.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(sum(g.values()) for g in group.values())
    assert max(load.values()) <= max(largest, 1.05 * sum(load.values()) / 40)


def test_op10(spark):
    docs = _docs(spark)
    taken, words = _taken(spark, {i: (d["source"], d["text"]) for i, d in docs.items()})
    rows = QUERIES["op10_mixing"](spark, SF0001).collect()
    assert {r["doc_id"]: (r["size"], r["taken"]) for r in rows} == {i: (len(words[i]), taken[i]) for i in docs} and len(rows) == len(docs)
    size = Counter()
    for i, d in docs.items():
        size[d["source"]] += len(words[i])
    names = sorted(size)
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))])))
    assert all(r["source_size"] == size[docs[r["doc_id"]]["source"]] and r["target"] == pytest.approx(goal[docs[r["doc_id"]]["source"]]) for r in rows)
    assert all((r["first_position"] is not None) == (r["taken"] > 0) for r in rows)
