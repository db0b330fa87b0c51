"""Queries that SQL does not express, row by row against plain loops over the same tables."""

import math
from collections import defaultdict
from datetime import timedelta

from tickloom.operators import text_prep as P
from tickloom.plans import conversations, texts


def test_chunk_documents(spark, sf_dir):
    """Sentences are gathered one by one until 400 tokens are reached; the next chunk goes back by 80."""
    want = {}
    for r in texts.table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        parts, held = [], ""
        for c in r["text"] or "":
            held += c
            if c in "。；！？.!?":
                parts.append(held.strip())
                held = ""
        parts = [p for p in [*parts, held.strip()] if p]
        cost = [max(1, len(p) // 2) for p in parts]
        at, no = 0, 0
        while at < len(parts):
            end = at
            while end < len(parts) and sum(cost[at:end]) < 400:
                end += 1
            no += 1
            want[r["doc_id"], no] = ("".join(parts[at:end]), sum(cost[at:end]))
            back = end
            while back > at + 1 and sum(cost[back:end]) < 80:
                back -= 1
            at = len(parts) if end == len(parts) else back
    found = texts.chunk_documents(spark, sf_dir).collect()
    assert {(r["doc_id"], r["chunk_no"]): (r["content"], r["tokens"]) for r in found} == want
    assert len({r["chunk_id"] for r in found}) == len(found) == len(want)


def test_token_window(spark, sf_dir):
    """Budget 400, four records at most: the anchor, then important records, then the others."""
    turns = {r["id"]: r for r in conversations._turns(spark, sf_dir).collect()}
    score = {r["id"]: r for r in conversations.importance_score(spark, sf_dir).collect()}
    by = defaultdict(list)
    for i, t in turns.items():
        if score[i]["kind"] != "NOISE":
            by[t["conv_id"]].append((t["at"], i))
    want = set()
    for conv, rows in by.items():
        ids = [i for _, i in sorted(rows)]
        tokens = {i: max(1, len(turns[i]["text"]) // 2) if turns[i]["text"] else 0 for i in ids}
        asked = [i for i in ids if score[i]["kind"] == "USER_QUERY"]
        chosen, used = set(asked[-1:]), sum(tokens[i] for i in asked[-1:])
        for important in (True, False):
            for i in reversed(ids):
                if i not in chosen and (score[i]["importance"] >= 8) == important and used < 400 and used + tokens[i] <= 400:
                    chosen.add(i)
                    used += tokens[i]
        kept = [i for i in ids if i in chosen]
        stay = set(kept[-4:]) | set(asked[-1:])
        want |= {(conv, i, used, len(kept) - len(stay)) for i in kept if i in stay}
    assert {tuple(r) for r in conversations.token_window(spark, sf_dir).collect()} == want and len(want) > 50


def test_profile_fold(spark, sf_dir):
    """Each user's statements in time order: set, unchanged, conflict; consent within two hours, 90 days of memory."""
    rows = defaultdict(list)
    for r in conversations._candidates(spark, sf_dir).collect():
        rows[r["conv_id"] % 50].append((r["at"], r["id"], r["text"] or "", [(c["key"], c["value"]) for c in r["candidates"]]))
    want = []
    for user, own in rows.items():
        values, waiting, written = {}, None, None
        for at, turn, text, found in sorted(own):
            if written and at - written > timedelta(days=90):
                values, written = {}, None
            if waiting and at - waiting[2] > timedelta(hours=2):
                waiting = None
            if waiting and "the " in text:
                values[waiting[0]], written = waiting[1], at
                want.append((user, turn, "confirmed", *waiting[:2]))
                waiting = None
            elif waiting and "que " in text:
                want.append((user, turn, "rejected", *waiting[:2]))
                waiting = None
            for key, value in found:
                if key in ("invest_style", "risk_preference", "holding_horizon"):  # none of the allowed values is in these texts
                    event = "refused"
                elif key not in values:
                    event, values[key], written = "set", value, at
                elif values[key] == value:
                    event = "unchanged"
                else:
                    event, waiting = "conflict", (key, value, at)
                want.append((user, turn, event, key, value))
    got = [tuple(r) for r in conversations.profile_fold(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and {e for _, _, e, _, _ in want} >= {"set", "conflict", "refused"}


def test_kb_retrieve(spark, sf_dir):
    """Fusion of the whole hit lists, boosts, age, and half a point off for each near duplicate."""
    lists = [texts._vector_hits(spark, sf_dir, 30).collect(), texts._bm25_hits(spark, sf_dir).collect()]
    entry = {r["doc_id"]: r for r in texts.table(spark, sf_dir, "documents").collect()}
    half = lambda x, k: math.floor(x * 10**k + 0.5) / 10**k
    total, fused = [defaultdict(int), defaultdict(int)], defaultdict(lambda: [0.0, 0.0])
    for k, hits in enumerate(lists):
        for r in hits:
            total[k][r["query_id"]] += 1
    for k, hits in enumerate(lists):
        for r in hits:
            n = total[k][r["query_id"]]
            fused[r["query_id"], r["chunk_id"]][k] = (n - r["rank"] + 1) / n * (0.7, 0.3)[k]
    by = defaultdict(list)
    for (q, c), (a, b) in fused.items():
        score, e = half(a + b, 9), entry.get(c)
        if e:
            score += 0.30 if e["source"] == "src1" else 0.25 if e["lang"] == "en" else 0.0
            days = c % 500
            score *= 1.5 if days <= 7 else 1.2 if days <= 90 else 0.8 if days <= 365 else 0.3
        by[q].append([half(score, 9), c, P.fingerprint(e["text"]) if e else 0])
    want = {}
    for q, rows in by.items():
        rows.sort(key=lambda r: (-r[0], r[1]))
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                if a[2] and b[2] and ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() <= 22:
                    (b if a[0] > b[0] else a)[0] -= 0.5
        rows = sorted(([half(s, 9), c] for s, c, _ in rows), key=lambda r: (-r[0], r[1]))
        want |= {(q, c): (s, k) for k, (s, c) in enumerate(rows[:30], 1)}
    got = {(r["query_id"], r["chunk_id"]): (r["score"], r["rank"]) for r in texts.kb_retrieve(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k][0] - want[k][0]) < 2e-9 and got[k][1] == want[k][1] for k in want)
