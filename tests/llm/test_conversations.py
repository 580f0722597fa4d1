"""Conversations against a plain program over all pairs, and small cases."""

import heapq
import json
import re
from collections import defaultdict

import pandas as pd
import pytest

from postloom.llm import conversations as C
from postloom.llm.survivor import STAND_INS, TRUST

MOJIBAKE = re.compile(r"=\?[A-Za-z0-9_-]+\?[QqBb]\?|�|[ÂÃ][\x80-\xBFŒœŠšŸŽžƒˆ˜–-›€™]|â€")


def clean(mid):
    bare = re.sub(r"[\s<>]+", "", mid or "").lower()
    return bare or None


def usable(t):
    return t is not None and t.strip() != "" and t.strip().lower() not in STAND_INS and not MOJIBAKE.search(t)


def brute(messages, refs, addresses, identities, days=60):
    rows = defaultdict(list)
    for r in messages:
        cm = clean(r["mid"])
        key = cm if cm and not cm.startswith("no-id-") else json.dumps([r["from_addr"], r["date"], r["subject"]])
        rows[key].append(r | {"cm": cm if cm and not cm.startswith("no-id-") else None})
    named, people = defaultdict(list), defaultdict(set)
    for r in refs:
        named[r["message_id"]].append(clean(r["ref_mid"]))
    for r in addresses:
        people[r["message_id"]].add((r["addr"] or "").strip().lower())
    own = {(r["addr"] or "").strip().lower() for r in identities}
    mails, by_mid = {}, {}
    for rs in rows.values():
        m = min(r["id"] for r in rs)
        rank = lambda r: (TRUST[::-1].index(r["content_state"]) if r["content_state"] in TRUST else -1, r["updated_at"] or -(2**62), -r["id"])
        dates = [r for r in rs if r["date"]]
        subjects = [r for r in rs if usable(r["subject"])]
        mails[m] = {
            "date": max(dates, key=rank)["date"] if dates else None, "subject": max(subjects, key=rank)["subject"] if subjects else None,
            "text": any((r["body"] or "").strip() for r in rs), "threads": {r["thread_id"] for r in rs if r["thread_id"] is not None},
            "names": {x for r in rs for x in [clean(r["in_reply_to"]), *named[r["id"]]] if x} - {rs[0]["cm"]},
            "people": {p for r in rs for p in people[r["id"]] | {(r["from_addr"] or "").strip().lower()}} - own - {""},
            "me": min((r["from_addr"] or "").strip().lower() for r in rs) in own,
        }
        if rs[0]["cm"]:
            by_mid[rs[0]["cm"]] = m
    up = {m: m for m in mails}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def tie(a, b):
        a, b = sorted((find(a), find(b)))
        up[b] = a

    first = {}
    for m, x in mails.items():
        for t in x["threads"]:
            tie(m, first.setdefault(t, m))
        for n in x["names"]:
            if n in by_mid:
                tie(m, by_mid[n])
        x["topic"] = re.sub(C.ANY_PREFIX.replace("(?i)", ""), "", x["subject"] or "", flags=re.I).strip().lower() or None
        x["loose"] = bool(x["subject"] and re.match(C.REPLY_PREFIX, x["subject"])) and not x["names"]
    topics = defaultdict(list)
    for m, x in mails.items():
        topics[x["topic"]].append(m)
    for m, x in mails.items():
        if x["loose"] and x["topic"] and x["date"] is not None:
            for o in topics[x["topic"]]:
                y = mails[o]
                if o != m and y["date"] is not None and abs(x["date"] - y["date"]) <= days * C.DAY and x["people"] & y["people"]:
                    tie(m, o)
    convs = defaultdict(list)
    for m in mails:
        convs[find(m)].append(m)
    out = set()
    for c, ms in convs.items():
        if len(ms) < 2 or not all(mails[m]["text"] for m in ms) or any(n not in by_mid for m in ms for n in mails[m]["names"]) or len({mails[m]["me"] for m in ms}) < 2:
            continue
        waits = {m: {by_mid[n] for n in mails[m]["names"]} - {m} for m in ms}
        ready = [(mails[m]["date"] or 0, m) for m in ms if not waits[m]]
        heapq.heapify(ready)
        turn = 0
        while ready:
            _, m = heapq.heappop(ready)
            turn += 1
            out.add((c, turn, m, "me" if mails[m]["me"] else "other"))
            for o in ms:
                if m in waits[o]:
                    waits[o].discard(m)
                    if not waits[o]:
                        heapq.heappush(ready, (mails[o]["date"] or 0, o))
    return out


def frames(spark, messages, refs=(), addresses=(), identities=()):
    base = {"mid": None, "from_addr": None, "date": None, "subject": None, "thread_id": None, "in_reply_to": None, "content_state": "full", "updated_at": 1, "body": "text"}
    shape = "id long, mid string, from_addr string, date long, subject string, thread_id long, in_reply_to string, content_state string, updated_at long, body string, key string, mail string"
    full = [base | m for m in messages]
    cols = [c.split()[0] for c in shape.split(", ")]
    return (
        spark.createDataFrame([tuple(m.get(c) for c in cols) for m in full], shape), spark.createDataFrame(list(refs), "message_id long, ref_mid string"),
        spark.createDataFrame(list(addresses), "message_id long, addr string, role string"), spark.createDataFrame(list(identities), "addr string"), full,
    )


def result(df):
    return {tuple(r) for r in df.select("conv_id", "turn_no", "message_id", "role").collect()}


def test_against_all_pairs(spark, tiny):
    names = ("messages", "refs", "addresses", "identities")
    for d in (tiny, tiny.replace("sf0.001", "sf0.01")):
        want = brute(*(pd.read_parquet(f"{d}/{t}.parquet").astype(object).where(lambda x: x.notna(), None).to_dict("records") for t in names))
        got = C.conversations(*(spark.read.parquet(f"{d}/{t}.parquet") for t in names))
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_small_cases(spark):
    day = C.DAY
    ms = [
        dict(id=1, mid="a@x", from_addr="me@x", date=10 * day, subject="Plan"),
        dict(id=2, mid=" <B@x>", from_addr="o@x", date=5 * day, subject="Re: Plan", in_reply_to="<a@\r\n x>"),  # wrong clock
        dict(id=3, mid="b@X", from_addr="O@x", date=5 * day, subject="Re: Plan"),  # the same mail again
        dict(id=4, mid="c@x", from_addr="me@x", date=6 * day, in_reply_to="b@x"),
        dict(id=5, mid="d@x", from_addr="me@x", date=7 * day, thread_id=9),
        dict(id=6, mid="e@x", from_addr="o@x", date=8 * day, thread_id=9, body=" \n"),  # no text
        dict(id=7, mid="f@x", from_addr="me@x", date=7 * day, thread_id=10),
        dict(id=8, mid="g@x", from_addr="o@x", date=8 * day, thread_id=10, in_reply_to="gone@x"),
        dict(id=9, mid="h@x", from_addr="me@x", date=7 * day, thread_id=11),
        dict(id=10, mid="i@x", from_addr="me@x", date=7 * day, thread_id=11),  # one role
        dict(id=11, mid="j@x", from_addr="o@x", date=None, thread_id=12, in_reply_to="j@x"),
        dict(id=12, mid="k@x", from_addr="me@x", date=0, thread_id=12),
        dict(id=13, mid="no-id-1", from_addr="p@x", date=100 * day, subject="[t] AW: Re: Topic"),
        dict(id=14, mid="no-id-2", from_addr="p@x", date=100 * day, subject="[t] AW: Re: Topic"),
        dict(id=15, mid="l@x", from_addr="me@x", date=50 * day, subject="topic"),
        dict(id=16, mid="m@x", from_addr="me@x", date=20 * day, subject="Topic"),
    ]
    args = frames(spark, ms, [(4, "B@x"), (4, "b@x")], [(15, "p@x", "to"), (16, "p@x", "to")], [("ME@x",), (None,)])
    got = result(C.conversations(*args[:4]))
    assert got == {
        (1, 1, 1, "me"), (1, 2, 2, "other"), (1, 3, 4, "me"), (11, 1, 11, "other"), (11, 2, 12, "me"), (13, 1, 15, "me"), (13, 2, 13, "other"),
    }


def test_a_thread_id_of_its_own_does_not_keep_a_reply_apart(spark):
    day = C.DAY
    ms = [
        dict(id=1, mid="a@x", from_addr="me@x", date=10 * day, subject="Plan 7", thread_id=1), dict(id=2, mid="b@x", from_addr="o@x", date=12 * day, subject="AW: Plan 7", thread_id=2),
        dict(id=3, mid="c@x", from_addr="o@x", date=90 * day, subject="AW: Plan 7", thread_id=3), dict(id=4, mid="d@x", from_addr="q@x", date=12 * day, subject="AW: Plan 7", thread_id=4),
    ]
    args = frames(spark, ms, addresses=[(1, "o@x", "to")], identities=[("me@x",)])
    assert result(C.conversations(*args[:4])) == {(1, 1, 1, "me"), (1, 2, 2, "other")}


def test_long_chain_with_a_wrong_clock_at_its_root(spark):
    n = 70
    ms = [dict(id=i, mid=f"m{i}@x", from_addr="me@x" if i % 2 else "o@x", date=10_000 if i == 1 else 10 * i, in_reply_to=f"m{i - 1}@x" if i > 1 else None) for i in range(1, n + 1)]
    args = frames(spark, ms, identities=[("me@x",)])
    got = result(C.conversations(*args[:4]))
    assert got == {(1, i, i, "me" if i % 2 else "other") for i in range(1, n + 1)} == brute(args[4], [], [], [{"addr": "me@x"}])
    steps = {tuple(r) for r in C.paths(args[0], args[1]).collect()}
    assert steps == {(n, i, i) for i in range(1, n + 1)}


def test_paths_from_root_to_leaf(spark):
    ms = [dict(id=i, mid=f"m{i}@x", from_addr="a@x", date=i, in_reply_to=r) for i, r in ((1, None), (2, "<M1@x>"), (3, "m2@x"), (4, "m2@x"), (5, None), (6, "gone@x"), (7, "m8@x"), (8, "m7@x"))]
    args = frames(spark, ms, [(5, "m1@x"), (5, "m3@x"), (5, "m5@x")])
    got = {tuple(r) for r in C.paths(args[0], args[1]).collect()}
    # 5 names 1 and 3 in its refs: the later one is its parent; 7 and 8 answer each other, so 7 is a root
    assert got == {(4, 1, 1), (4, 2, 2), (4, 3, 4), (5, 1, 1), (5, 2, 2), (5, 3, 3), (5, 4, 5), (6, 1, 6), (8, 1, 7), (8, 2, 8)}
    assert C.paths(args[0].limit(0), args[1].limit(0)).count() == 0


def test_circle_and_empty(spark):
    ms = [dict(id=1, mid="a@x", from_addr="me@x", date=2, in_reply_to="b@x"), dict(id=2, mid="b@x", from_addr="o@x", date=1, in_reply_to="a@x")]
    args = frames(spark, ms, identities=[("me@x",)])
    assert {r[1:3] for r in result(C.conversations(*args[:4]))} == {(1, 2), (2, 1)}
    empty = [f.limit(0) for f in args[:4]]
    assert C.conversations(*empty).count() == 0
