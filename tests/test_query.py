"""The search language: trees, dates, sizes, and identities that must hold between queries."""

import pytest

from postloom.lang import dates
from postloom.lang.compile import Mailbox, select
from postloom.lang.query import And, Not, Or, QueryError, Term, free_text, parse
from postloom.operators import counts

NOW = 1_772_323_200_000


def test_trees():
    assert parse("a OR b c") == And((Or((Term(None, "a"), Term(None, "b"))), Term(None, "c")))
    assert parse("-x") == Not(Term(None, "x")) == parse("NOT x")
    assert parse("(from:anna OR to:anna) plan") == And((Or((Term("from", "anna"), Term("to", "anna"))), Term(None, "plan")))
    assert parse("-(a b)") == Not(And((Term(None, "a"), Term(None, "b"))))
    assert parse("a AND b") == parse("a b")
    assert parse('since:2025 folder:"A B"') == And((Term("after", "2025"), Term("in", "A B", True)))
    assert parse("https://x.example/a") == Term(None, "https://x.example/a")
    assert parse("subject:(a b)") == Term("subject", "a b")
    assert parse('-"!"') is None and parse("") is None and parse(None) is None
    assert free_text("rechnung from:x stadt -weg") == "rechnung stadt"


@pytest.mark.parametrize("bad", ["a OR", "OR a", "()", "a )", "from:", "wrong:x", "(" * 21 + "a", "x " * 201, "y" * 20_001])
def test_refused(bad):
    with pytest.raises(QueryError):
        parse(bad)


def test_dates_and_sizes():
    day = 24 * dates.HOUR
    assert dates.period("2025-02", NOW) == (1738368000000, 1738368000000 + 28 * day)
    assert dates.period("14.03.2025", NOW)[0] == dates.period("2025/3/14", NOW)[0]
    assert dates.period("2025", NOW)[1] == dates.period("2026", NOW)[0]
    assert dates.period("heute", NOW)[0] - dates.period("yesterday", NOW)[0] == day
    assert dates.relative("2w", NOW) == NOW - 14 * day and dates.relative("2x", NOW) is None
    assert dates.size("1.5K") == 1536 and dates.size("2M") == 2 << 20
    for bad in ("2025-13", "30.02.2025", "soon"):
        with pytest.raises(QueryError):
            dates.period(bad, NOW)
    with pytest.raises(QueryError):
        dates.size("much")


def test_identities(spark, tiny):
    box = Mailbox.read(spark, tiny)
    n = lambda q: counts.total(box, q).first()["n"]
    ids = lambda q: {r["id"] for r in select(box, q)[0].select("id").collect()}
    everything = ids("")
    assert ids("is:unread") | ids("is:read") | {r["id"] for r in box.messages.filter("read is null").select("id").collect()} == everything
    assert ids("in:sent") ^ ids("-in:sent") == everything and not ids("in:sent") & ids("-in:sent")
    assert ids("with:a") == ids("from:a OR to:a") | ids("with:a")
    assert ids("müller OR rechnung") == ids("mueller OR rechnung")
    assert sum(r["n"] for r in counts.count_by(box, "direction").collect()) >= n("")
    assert n("after:2025 before:2026") == n("since:2025 until:2025")
    assert ids("NOT (is:unread OR is:flagged)") == everything - ids("is:unread") - ids("is:flagged")
    for bad in ("has:wings", "is:happy", "larger:x", "thread:x", "newer_than:x", "is:unraed"):
        with pytest.raises(QueryError):
            select(box, bad)
    with pytest.raises(QueryError):
        counts.count_by(box, "year", "year")
