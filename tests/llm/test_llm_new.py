"""Conversation repair, ranked search and likelihood-ratio rules against brute force, and awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from provenance_spark.llm import conversation_repair as repair
from provenance_spark.llm import quality_llr, search_taat
from provenance_spark.llm.queries import QUERIES, RANKED

# ---- conversation repair

WELL = re.compile(r"(s?(ua)+)?\Z")


def least_edits(rows):
    """Cheapest (cost, audit) by relaxing every node of the lattice layer by layer, written apart from the operator."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                for to in after[state]:
                    if to != "s":
                        table[to] = min(table.get(to, (1 << 40, "")), (cost + 2, audit + "I"))
        return table

    for role, gone, late in rows:
        new = {}
        for state, (cost, audit) in inserts(best).items():
            found = [(state, cost + 3, audit + "D")]
            if not gone:
                found += [(to, cost + late, audit + "K") for to in after[state] if to == role]
                found += [(to, cost + 2 + late, audit + "R") for to in after[state] if to != "s"]
            for to, c, a in found:
                new[to] = min(new.get(to, (1 << 40, "")), (c, a))
        best = new
    best = inserts(best)
    return min(best[t] for t in ("", "a") if t in best)


def brute_repair(rows):
    """(conv_id, turn, role, text) to the digest rows, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        held = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            held += [(turn is not None, turn or 0, ("user" if kind == 4 else role), text)] * (2 if kind == 3 else 1)
        held.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        faults = Counter()
        seen, lattice = set(), []
        for _, _, role, text in held:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            lattice.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = least_edits(lattice)
        lines, i, last = [], 0, ""
        for e in audit:
            if e == "D":
                i += 1
                continue
            role = held[i][2] if e == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{'' if e == 'I' else held[i][3]}")
            i, last = i + (e != "I"), role[:1]
        assert WELL.match("".join(x[:1] for x in lines))
        turns = [r[1] for r in held if r[0]]
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                     pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def digest_of(df):
    rows = df.collect()
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_bidirectional_search_equals_layers():
    rng = random.Random(4)
    for _ in range(4000):
        rows = [(rng.choice("ssuuuaaax"), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(rng.randint(0, 9))]
        assert repair.cheapest(rows, 0, repair.ENDS) == least_edits(rows), rows


def test_conversation_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digest_of(QUERIES["op11_conversation_repair"](spark, SF_MID)) == brute_repair(rows)


def test_long_conversations_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    said = ["Yes.", "No", "Why?", "", "a line\nmore.", "Gut!", " \t"] + [f"text {i}{rng.choice(['.', ''])}" for i in range(400)]
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(said)) for t in range(900)]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(said)) for c in range(2, 30) for t in range(rng.randint(1, 6))]
    rows += [(40, None, "user", "Yes."), (40, 3, "user", "Yes."), (40, 3, "user", "Yes."), (40, 3, "assistant", "Yes."), (41, None, None, None),
             (None, 1, "user", "Lost?"), (None, 2, "assistant", "Here."), (42, 5, "", "Who?"), (43, 1, "User", "Case."), (44, 1, "user", "x" * 200_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = df.select("*", F.lit(1).alias("piece"), F.lit("z").alias("audit"), F.lit(2).alias("cost"), F.lit("w").alias("whole")).repartition(5)
    want = brute_repair(rows)
    assert digest_of(repair.digest(repair.repaired(repair.damaged(extra)))) == want
    made = repair.repaired(repair.damaged(df))
    assert made.where("conv_id = 1").count() > 3 and made.agg(F.max("n_rows")).first()[0] <= repair.PIECE_ROWS
    lines = repair.messages(made).where("conv_id = 1").orderBy("piece", "place").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in lines).encode()).hexdigest() == want[1][-1]


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digest(repair.repaired(repair.damaged(empty))).collect() == []
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(7, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert digest_of(repair.digest(repair.repaired(repair.damaged(one)))) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    plain = spark.createDataFrame([(7, 1, "user", "Hi."), (7, 2, "assistant", "Yes."), (7, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert digest_of(repair.digest(repair.repaired(plain)))[7][5:7] == (3, "KKD")


# ---- ranked search


def brute_search(docs, items, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = {c: c + 32 for c in range(65, 91)}
    bags = [(i, word.findall((t or "").translate(fold))) for i, t in docs if i is not None]
    bags = [(i, len(w), Counter(w)) for i, w in bags if w]
    n_docs, n_tokens = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = set()
    least = {}
    for i, t in items:
        if i is not None:
            least[i] = t if least.get(i) is None else min(least[i], t) if t is not None else least[i]
    for i, text in least.items():
        scored = []
        for doc, n, c in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in word.findall((text or "").translate(fold)) if t in c)
            if s > 0:
                scored.append((-s, doc))
        out |= {(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def as_set(df):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()}


def test_search_beyond_the_broadcast_and_in_blocks(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    want = brute_search([tuple(r) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 5)
    assert as_set(search_taat.search(docs, items, 5)) == want
    assert as_set(search_taat.search(docs, items, 5, broadcast=10, block=7)) == want


def test_search_awkward_rows(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, " .. "), (None, "alpha"), (5, "Alpha " * 50_000 + "gamma"), (6, "beta été Été"), (7, "delta")]
    items = [(1, "alpha alpha gamma"), (2, None), (3, "nowhere"), (None, "alpha"), (4, "ÉTÉ été beta"), (4, "ÉTÉ été beta"), (5, "z"), (5, "delta!")]
    d = spark.createDataFrame([(*r, 1, "s") for r in docs], "doc_id long, text string, n int, term string").repartition(3)
    b = spark.createDataFrame([(*r, "x", 2) for r in items], "item_id long, text string, item string, score int")
    got = search_taat.search(d, b, 3)
    assert as_set(got) == brute_search(docs, items, 3)
    assert search_taat.search(d.where("false"), b, 3).count() == search_taat.search(d, b.where("false"), 3).count() == 0


def test_search_stops_opening_accumulators():
    rng = np.random.default_rng(1)
    n, common = 5000, 400
    ids, lengths = np.arange(n), np.full(n, 100)
    of = np.concatenate([rng.choice(n, 40, replace=False), *(rng.choice(n, 4000, replace=False) for _ in range(common))])
    term = np.concatenate([np.zeros(40, int), *(np.full(4000, t + 1) for t in range(common))])
    w = search_taat.weight(n, np.array([40] + [4000] * common))
    shard = search_taat.Shard(ids, lengths, of, term, np.ones(len(of), np.int64), w, n, n * 100)
    best = search_taat.Best(10)
    shard.read(np.arange(6), np.ones(6, np.int64), best)
    score = np.zeros(n, np.int64)
    for t in range(6):
        at = of[term == t]
        score[at] += search_taat.impact(w[t], np.ones(len(at), np.int64), lengths[at], n, n * 100)
    order = np.lexsort((ids, -score))[:10]
    assert shard.opened == 40 and best.ids.tolist() == order.tolist() and best.scores.tolist() == score[order].tolist()


# ---- likelihood-ratio rules


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def brute_grams(text):
    tokens = re.findall(rb"[0-9a-z\x80-\xff]+|[^\x00-\x200-9a-z\x80-\xff]+", (text or "").encode().lower())
    h = [zlib.crc32(t) for t in tokens]
    all_ = h + [a * 0x1F123BB5 + b + (1 << 33) for a, b in itertools.pairwise(h)]
    return [((x + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - quality_llr.BITS) for x in all_]


def test_rules_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect() if r["quality"] == 1 and not r["toxic"]}
    grams = {i: brute_grams(t) for i, t in rows.items()}
    raw, trusted = Counter(g for x in grams.values() for g in x), Counter(g for i in good & set(rows) for g in grams[i])
    share = sum(trusted.values()) / sum(raw.values())
    got = QUERIES["op13_quality_llr"](spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute_base(rows[r["doc_id"]])
        score = sum(math.log((trusted[g] + quality_llr.PSEUDO) / (raw[g] * share + quality_llr.PSEUDO)) for g in grams[r["doc_id"]])
        score /= max(1, len(grams[r["doc_id"]]))
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*base, failed)
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["kept"] == (not failed and r["score"] >= quality_llr.LEAST)


def test_rules_keep_good_documents_and_drop_bad_ones(spark):
    got = QUERIES["op13_quality_llr"](spark, SF_MID).where("NOT base_failed").join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["share"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1


def test_rules_awkward_rows(spark):
    texts = [None, "", " \n\t ", "a b c a b c", "x\n\nx\n x\nx", "é " * 60, "# $ %% <b>" * 30, "one two three " * 30_000, "\x00\x01 \x0b a"]
    rows = [(i, t, 1, "k", 0.5, "r") for i, t in enumerate(texts)] + [(None, "a b", 1, "k", 0.5, "r"), (1, "a b c a b c", 1, "k", 0.5, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trusted int, kept string, score double, raw_text string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    table = quality_llr.fit(docs, quality_llr.trusted_ids(labels, F.col("quality") == 1))
    got = quality_llr.annotate(docs, table).collect()
    assert [tuple(r["rules"])[:5] for r in got] == [brute_base(r[1]) for r in rows]
    assert got[0]["rules"]["score"] == 0 and got[0]["rules"]["base_failed"] and not got[0]["rules"]["kept"]
    assert quality_llr.keep(docs, table).columns == docs.columns
    assert not quality_llr.fit(docs.where("false"), labels.select("doc_id")).any() and quality_llr.annotate(docs.where("false"), table).count() == 0
    rng = random.Random(2)
    for n, kinds in ((3000, 4), (3000, 50), (2, 1), (5, 1)):
        words = [str(rng.randrange(kinds)) for _ in range(n)]
        assert quality_llr.repeated_words([w.encode() for w in words]) == brute_base(" ".join(words))[4]


def test_pipeline_stages_on_awkward_and_empty_tables(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40)
    first = docs.orderBy("doc_id").first().asDict()
    odd = [first, {**first, "doc_id": None}, {**first, "doc_id": 900001, "text": None}, {**first, "doc_id": 900002, "text": ""},
           {**first, "doc_id": 900003, "text": "word " * 50_000, "source": None, "lang": None}]
    whole = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    whole = whole.withColumn("kept", F.lit("k")).withColumn("found", F.lit(1)).withColumn("language", F.lit("x")).withColumn("component_id", F.lit(2))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    for name, stage in stages.items():
        out, none = stage(spark, whole, SF_SMALL), stage(spark, whole.limit(0), SF_SMALL)
        assert set(out.columns) - {"epoch"} == set(whole.columns) and none.isEmpty(), name
        got, before = ids(out), ids(whole)
        if name == "language ID":
            assert got == [i for i in before if i[1] not in (900001, 900002)]
        elif name == "line dedup":
            assert got == before
        elif name == "SimHash near-dedup":  # repeated rows become one; a null id stays
            assert len(set(got)) == len(got) and (True, 0) in got and (False, first["doc_id"]) in got
        elif name == "benchmark decontamination":
            assert {(False, 900001), (False, 900002), (False, 900003)} <= set(got)
        else:
            assert set(got) <= set(before)
