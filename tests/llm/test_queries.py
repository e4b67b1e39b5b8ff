"""Every registered query of the subpackage, run on the smallest tables and held against its contract."""

import collections
import hashlib
import re
import types
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

from .plain import contaminated, quality_scores, tokens
from .test_simhash import groups, plain

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    read = lambda name: duckdb.sql(f"select * from read_parquet('{DIR}/{name}.parquet')").fetchall()
    return {"documents": {r[0]: r[1] or "" for r in read("documents")}, "conversations": read("conversations"), "labels": read("labels")}


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def get(name):
        if name not in done:
            full = next(n for n in entry.queries() if n.startswith(f"{name}_"))
            done[name] = [r.asDict(recursive=True) for r in entry.queries()[full](spark, DIR).collect()]
        return done[name]

    return get


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1_sums_are_those_of_the_documents(table, result):
    rows = sorted(result("op1"), key=lambda r: r["n_tokens"])
    docs = [(r["n_tokens"], r["docs"]) for r in rows]
    assert sum(n for _, n in docs) == len(table["documents"])
    total = sum(a * n for a, n in docs)
    for k, r in enumerate(rows):
        over = docs[k:]
        assert r["docs_ge"] == sum(n for _, n in over) and r["tokens_ge"] == sum(a * n for a, n in over) and r["tokens_total"] == total
        assert r["truncated_tokens"] == sum(min(a, r["n_tokens"]) * n for a, n in docs)


def test_op2_is_what_brute_force_removes(table, result):
    texts = {i: t.encode() for i, t in table["documents"].items()}
    seen = collections.Counter(t[a : a + 400] for t in texts.values() for a in range(len(t) - 399))
    for r in result("op2"):
        t = texts[r["doc_id"]]
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 399):
            if seen[t[a : a + 400]] > 1:
                gone[a : a + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), int(gone.sum()), spans, sha(kept))
    assert len(result("op2")) == len(texts)


def test_op3_reads_back_every_turn(table, result):
    by = collections.defaultdict(list)
    for conv, turn, role, text in [tuple(r[:4]) for r in table["conversations"]] + [(-7, k, r, r"\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant"))]:
        by[conv].append((turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in result("op3")}
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] > 0


def test_op4_scores_every_document(table, result):
    rows = {r["doc_id"]: r for r in result("op4")}
    assert set(rows) == set(table["documents"])
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    own = [(rows[i]["predicted"], q) for i, q, *_ in table["labels"] if i in rows and rows[i]["held_out"] and q in (0, 1)]
    assert not own or sum(a == b for a, b in own) >= 0.8 * len(own)


def test_op4_scores_are_those_of_the_plain_version(table, result):
    agreed = {}
    for i, q, *_ in table["labels"]:
        agreed.setdefault(i, set()).add(q)
    want = quality_scores(table["documents"], {i: next(iter(q)) for i, q in agreed.items() if len(q) == 1 and q <= {0, 1} and i in table["documents"]})
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in result("op4"))


def test_op5_equals_its_twin(result):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{DIR}/documents.parquet')")
    want = db.execute(entry.oracle_sql()["op5_exact_dedup"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in result("op5")) == sorted(want.fetchall())


def test_op6_fingerprints_and_components(table, result):
    rows = sorted(result("op6"), key=lambda r: r["doc_id"])
    fps = [plain(table["documents"][r["doc_id"]]) for r in rows]
    assert [r["fingerprint"] for r in rows] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in rows] == [rows[k]["doc_id"] for k in groups(fps)]


def test_op7_gives_the_texts_back(table, result):
    assert {r["doc_id"]: r["text_sha256"] for r in result("op7")} == {i: sha(t) for i, t in table["documents"].items()}
    assert all(r["exact"] for r in result("op7"))


def test_op8_has_a_row_for_each_document(table, result):
    rows = result("op8")
    assert sorted(r["doc_id"] for r in rows) == sorted(table["documents"])
    assert all(r["contaminated"] == bool(r["item_ids"]) and (r["most_matches"] > 0) == r["contaminated"] for r in rows)
    items = [t for _, t in duckdb.sql(f"select item_id, text from read_parquet('{DIR}/benchmark.parquet')").fetchall() if t]
    grams = {g for t in items for g in zip(*(tokens(t)[k:] for k in range(4)))}
    # The plain version compares every diagonal; it is asked about all documents that share four tokens in a row with an item.
    near = [i for i, t in table["documents"].items() if grams & set(zip(*(tokens(t)[k:] for k in range(4))))]
    for r in rows:
        assert not r["contaminated"] or r["doc_id"] in near
    for i in near[:40]:
        want = any(contaminated(table["documents"][i], t) for t in items)
        assert next(r["contaminated"] for r in rows if r["doc_id"] == i) == want, i


def test_op9_is_one_law_over_all(table, result):
    rows = result("op9")
    assert sorted(r["doc_id"] for r in rows) == sorted(table["documents"])
    shards, of_text = collections.defaultdict(list), {}
    for r in rows:
        t = table["documents"][r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        assert 0 <= r["shard"] < 24 and of_text.setdefault(t, r["shard"]) == r["shard"]
        shards[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in shards.values())


def test_op10_finds_the_base_spans(table, result):
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    for r in result("op10"):
        found, counts = [], []
        for k, (kind, rule, group, least) in enumerate(rules):
            own = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in rule.finditer(table["documents"][r["doc_id"]]) if len(m.group(group)) >= least]
            counts.append(len(own))
            found += own
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(counts) and r["base_sha256"] == sha(",".join(x for *_, x in sorted(found)))


def test_op12_is_what_integers_give(spark, result):
    from .test_whitening import held_against_plain

    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{DIR}/embeddings.parquet')").fetchall()
    held_against_plain([types.SimpleNamespace(**r) for r in result("op12")], [(i, list(v) if v is not None else None) for i, v in rows])


def test_op13_is_what_the_definition_gives(table, result):
    from .test_runs import NAMES, report

    assert {tuple(r[c] for c in NAMES) for r in result("op13")} == {report(i, t) for i, t in table["documents"].items()}
    assert len(result("op13")) == len(table["documents"]) and any(r["n_runs"] for r in result("op13"))


def test_op11_equals_its_twin(result):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{DIR}/documents.parquet')")
    want = db.execute(entry.oracle_sql()["op11_recompression"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in result("op11")) == sorted(want.fetchall())
