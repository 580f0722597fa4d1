"""Conversations rebuilt from message rows as ordered turns with the roles me and other.

Rows of one mail (same Message-ID however written; for stand-ins same sender, date and subject) are one turn.  Mails
are tied by a shared thread id, by naming each other in in_reply_to or refs, and, for replies that name none, by
subject and a shared participant within 60 days.  Ties are contracted by pointer jumping; turns are ordered by date,
but never before a mail that they name, which is resolved by doubling the reach of the naming relation.  ``paths``
gives the paths from the root of a conversation to each of its leaves.

Defined results: dropped are conversations of one turn, with a turn without text, naming a mail that is not in the
table, or with one role; a mail naming itself names nothing; where mails name each other in a circle the earlier
ones do not wait for the latest; mails without a date come first; repeated rows and repeated references change nothing; an empty
table gives an empty result; other columns are ignored.  A tie by subject joins neighbours in time only, so a frequent subject does
not make pairs of all its mails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.mids import clean_mid, is_stand_in
from postloom.llm.survivor import TRUST, mail_key, usable_text
from postloom.plans.components import connected_components
from postloom.plans.lineage import cut

DAY = 86_400_000
REPLY_PREFIX = r"(?i)^\s*(?:\[[^\]]*\]\s*)*(?:re|aw|antw|antwort|sv|tr|rép|rep|r)\s*(?:\[\d+\]|\(\d+\)|\^\d+)?\s*:"
ANY_PREFIX = r"(?i)^(?:\s*(?:(?:re|aw|antw|antwort|sv|tr|rép|rep|r|fw|fwd|wg|i)\s*(?:\[\d+\]|\(\d+\)|\^\d+)?\s*:|\[[^\]]*\]))+\s*"


def mails(messages: DataFrame) -> DataFrame:
    """One row per mail: key, mail (smallest id), best date, subject, sender, whether any row has text, thread ids."""
    trust = F.lit(0)
    for i, state in enumerate(reversed(TRUST)):
        trust = F.when(F.col("content_state") == state, F.lit(i + 1)).otherwise(trust)
    rank = (trust.alias("t"), F.coalesce("updated_at", F.lit(-(2**62))).alias("u"), (-F.col("id")).alias("n"))
    rows = messages.select(
        "id", mail_key(F.col("mid"), F.col("from_addr"), F.col("date"), F.col("subject")).alias("key"), clean_mid(F.col("mid")).alias("cm"), "thread_id",
        F.lower(F.trim("from_addr")).alias("sender"), F.when(F.col("date") != 0, F.struct(*rank, F.col("date").alias("v"))).alias("d"),
        F.when(usable_text(F.col("subject")), F.struct(*rank, F.col("subject").alias("v"))).alias("s"),
        F.coalesce(F.regexp_replace("body", r"[\s\x{A0}\x{200B}\x{FEFF}]+", "") != "", F.lit(False)).alias("has_text"),
    )
    return rows.groupBy("key").agg(
        F.min("id").alias("mail"), F.max("d")["v"].alias("date"), F.max("s")["v"].alias("subject"), F.min("sender").alias("sender"),
        F.max("has_text").alias("has_text"), F.min(F.when(~is_stand_in(F.col("cm")), F.col("cm"))).alias("cm"),
    )


def _subject_ties(repliers: DataFrame, one: DataFrame, who: DataFrame, days: int) -> DataFrame:
    """(a, b) neighbours in time with the same subject and participant that lie in the window of one replier."""
    wanted = repliers.select("topic").distinct()
    span, reach = 2 * 365 * DAY, 2 * days * DAY
    base = one.filter("topic is not null and date is not null").join(wanted, "topic", "left_semi").join(who, "mail").select("topic", "person", "mail", "date", "loose")
    # slices in time that overlap by twice the reach keep every partition of the window bounded by a time span
    slot = F.floor(F.col("date") / span)
    sliced = base.withColumn("slot", F.explode(F.array_distinct(F.array(slot, F.floor((F.col("date") - reach) / span), F.floor((F.col("date") + reach) / span)))))
    key = ["topic", "person", "slot"]
    w = Window.partitionBy(*key).orderBy("date", "mail")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col("loose"), F.col("date"))
    steps = sliced.select("mail", "date", F.lead("mail").over(w).alias("next"), F.lead("date").over(w).alias("next_date"), F.max(at).over(back).alias("before"), F.min(at).over(ahead).alias("after"))
    near = days * DAY
    return steps.filter((F.col("before") >= F.col("next_date") - near) | (F.col("after") <= F.col("date") + near)).select(F.col("mail").alias("a"), F.col("next").alias("b"))


def _keys(own: DataFrame, names: DataFrame) -> DataFrame:
    """(mail, key): the list of moments by which each mail stands; own: (mail, own), names: (mail, named).

    The key of a mail is the latest of the lists that its paths over named mails give, where a path gives the moments
    that are later than all after them.  Such lists can be put together: that of a path and of the path that begins
    at its end make that of both.  Each round therefore looks one mail further and doubles the reach of the best path
    so far, so that a chain takes as many rounds as the logarithm of its depth.  A mail whose own moment comes up
    among what it waits for is the latest of a circle; no earlier mail waits for it then, and nothing else is touched.
    """
    links = cut(names.join(own.select("mail", F.col("own").alias("self")), "mail"))
    start = own.select("mail", "own", F.array("own").alias("key"), F.lit(0).cast("bigint").alias("far"), F.col("mail").alias("end"))
    state = cut(start)
    first = lambda far, near: F.concat(F.filter(far, lambda x: x > near[0]), near)
    while True:
        step = links.join(state.select(F.col("mail").alias("named"), F.col("key").alias("k"), (F.col("far") + 1).alias("f"), F.col("end").alias("e")), "named")
        one = step.groupBy("mail").agg(F.max(F.struct("k", "f", "e")).alias("up"))
        jump = state.select(F.col("mail").alias("end"), F.col("key").alias("jk"), F.col("far").alias("jf"), F.col("end").alias("je"))
        both = state.join(one, "mail", "left").join(jump, "end", "left")
        paths = F.array(
            F.struct(F.col("key").alias("k"), F.col("far").alias("f"), F.col("end").alias("e")),
            F.struct(F.coalesce(first(F.col("up.k"), F.array("own")), F.col("key")).alias("k"), F.coalesce("up.f", "far").alias("f"), F.coalesce("up.e", "end").alias("e")),
            F.struct(first(F.col("jk"), F.col("key")).alias("k"), (F.col("far") + F.col("jf")).alias("f"), F.col("je").alias("e")),
        )
        circle = F.coalesce(F.array_contains("up.k", F.col("own")), F.lit(False))
        nxt = cut(both.select("mail", "own", F.array_max(paths).alias("p"), circle.alias("circle"), "key", "far").select("mail", "own", F.col("p.k").alias("key"), F.col("p.f").alias("far"), F.col("p.e").alias("end"), "circle", ((F.col("p.k") != F.col("key")) | (F.col("p.f") != F.col("far"))).alias("new")))
        seen = nxt.agg(F.max("circle").alias("circle"), F.max("new").alias("new")).first()
        if seen["circle"]:
            latest = nxt.filter("circle").select(F.col("mail").alias("named"), F.col("own").alias("latest"))
            links = cut(links.join(latest, "named", "left").filter("latest is null or self > latest").drop("latest"))
            state = cut(start)
        elif seen["new"]:
            state = nxt.select("mail", "own", "key", "far", "end")
        else:
            return nxt.select("mail", "key")


def _turn_order(turns: DataFrame, names: DataFrame) -> DataFrame:
    """turns (conv_id, mail, date) with turn_no; names: (mail, named), both in the same conversation.

    The rule "the earliest mail all of whose named mails stand already" equals an order by a list of moments: the
    latest mail that must come before this one, then the latest of those between that one and this, and so on down to
    the mail itself.  For a mail that names only earlier ones the list is its own moment alone.
    """
    order = F.struct(F.coalesce("date", F.lit(0)).alias("d"), F.col("mail").alias("m"))
    own = turns.select("conv_id", "mail", order.alias("own"))
    late = names.join(own.select("mail", "conv_id", "own"), "mail").join(own.select(F.col("mail").alias("named"), F.col("own").alias("other")), "named").filter("other > own")
    # only conversations where a mail names a later one need more than the date order
    some = cut(late.select("conv_id").distinct())
    keyed = own.select("conv_id", "mail", F.array("own").alias("key"))
    if not some.isEmpty():
        involved = cut(own.join(some, "conv_id", "left_semi"))
        links = names.join(involved.select("mail"), "mail", "left_semi")
        keys = _keys(involved.select("mail", "own"), links)
        keyed = keyed.join(some, "conv_id", "left_anti").unionByName(involved.select("conv_id", "mail").join(keys, "mail"))
    # numbers are counted per stretch of time first, so that a conversation of any length is no single sort
    stretch = F.floor(F.col("key")[0]["d"] / (30 * DAY))
    slots = keyed.withColumn("slot", stretch)
    counts = slots.groupBy("conv_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "slot", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "slot").orderBy("key"))
    return slots.select("conv_id", "slot", "mail", inside.alias("k")).join(offsets, ["conv_id", "slot"]).select("conv_id", "mail", (F.col("k") + F.col("offset")).cast("int").alias("turn_no"))


def conversations(messages: DataFrame, refs: DataFrame, addresses: DataFrame, identities: DataFrame, days: int = 60) -> DataFrame:
    """(conv_id, turn_no, message_id, role) of the kept conversations."""
    keyed = messages.select("id", mail_key(F.col("mid"), F.col("from_addr"), F.col("date"), F.col("subject")).alias("key"), "thread_id", clean_mid(F.col("in_reply_to")).alias("reply"))
    one = cut(mails(messages))
    ids = cut(keyed.join(one.select("key", "mail", "cm"), "key").select("id", "mail", "thread_id", "reply", "cm"))

    # what a mail names: in_reply_to may hold several ids only in broken headers, which cleaning makes one
    said = ids.filter("reply is not null").select("mail", "cm", F.col("reply").alias("ref"))
    listed = refs.select(F.col("message_id").alias("id"), clean_mid(F.col("ref_mid")).alias("ref")).filter("ref is not null").join(ids.select("id", "mail", "cm"), "id").select("mail", "cm", "ref")
    named_ids = said.unionByName(listed).filter(~F.col("ref").eqNullSafe(F.col("cm"))).select("mail", "ref").distinct()
    known = one.filter("cm is not null").select(F.col("cm").alias("ref"), F.col("mail").alias("named"))
    resolved = cut(named_ids.join(known, "ref", "left").select("mail", "named"))
    names = resolved.filter("named is not null and named <> mail")
    orphaned = resolved.filter("named is null").select("mail").distinct()

    own = identities.select(F.lower(F.trim("addr")).alias("person")).filter("person is not null").distinct()
    has_names = resolved.select("mail").distinct().withColumn("names_some", F.lit(True))
    topic = F.lower(F.trim(F.regexp_replace("subject", ANY_PREFIX, "")))
    topics = one.select("mail", "date", F.when(topic != "", topic).alias("topic"), F.coalesce(F.col("subject").rlike(REPLY_PREFIX), F.lit(False)).alias("is_reply"))
    # a thread id of its own does not keep a reply that names nothing apart: thread ids may be outdated
    loose = topics.join(has_names, "mail", "left").withColumn("loose", F.col("is_reply") & F.col("names_some").isNull())
    loose = cut(loose.select("mail", "date", "topic", "loose"))
    people = (
        addresses.select(F.col("message_id").alias("id"), F.lower(F.trim("addr")).alias("person")).unionByName(messages.select("id", F.lower(F.trim("from_addr")).alias("person")))
        .filter("person is not null and person <> ''").join(ids.select("id", "mail"), "id").select("mail", "person").distinct().join(own, "person", "left_anti")
    )
    by_subject = _subject_ties(loose.filter("loose and topic is not null"), loose, people, days)

    threads = ids.filter("thread_id is not null").select("thread_id", "mail")
    hubs = threads.groupBy("thread_id").agg(F.min("mail").alias("a"))
    by_thread = threads.join(hubs, "thread_id").select("a", F.col("mail").alias("b"))
    edges = by_thread.unionByName(names.select(F.col("mail").alias("a"), F.col("named").alias("b"))).unionByName(by_subject)
    group = connected_components(edges)

    turns = one.join(group.withColumnRenamed("node", "mail"), "mail").join(own.withColumn("mine", F.lit(True)), F.col("sender") == F.col("person"), "left")
    turns = turns.join(orphaned.withColumn("orphan", F.lit(True)), "mail", "left").select(
        F.col("component").alias("conv_id"), "mail", "date", "has_text", F.coalesce("mine", F.lit(False)).alias("mine"), F.coalesce("orphan", F.lit(False)).alias("orphan")
    )
    turns = cut(turns)
    kept = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("has_text").alias("t"), F.max("orphan").alias("o"), F.min("mine").alias("a"), F.max("mine").alias("b"))
    kept = kept.filter("n > 1 and t and not o and a <> b").select("conv_id")
    turns = cut(turns.join(kept, "conv_id", "left_semi"))
    ordered = _turn_order(turns, names.join(turns.select("mail"), "mail", "left_semi"))
    return ordered.join(turns.select("mail", "mine"), "mail").select("conv_id", "turn_no", F.col("mail").alias("message_id"), F.when(F.col("mine"), "me").otherwise("other").alias("role"))


def _named(messages: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mails, and (mail, ref, direct): what each names by in_reply_to (direct) or in refs, itself aside."""
    keyed = messages.select("id", mail_key(F.col("mid"), F.col("from_addr"), F.col("date"), F.col("subject")).alias("key"), clean_mid(F.col("in_reply_to")).alias("reply"))
    one = cut(mails(messages))
    ids = keyed.join(one.select("key", "mail", "cm"), "key").select("id", "mail", "reply", "cm")
    said = ids.filter("reply is not null").select("mail", "cm", F.col("reply").alias("ref"), F.lit(True).alias("direct"))
    listed = refs.select(F.col("message_id").alias("id"), clean_mid(F.col("ref_mid")).alias("ref")).filter("ref is not null").join(ids.select("id", "mail", "cm"), "id").select("mail", "cm", "ref", F.lit(False).alias("direct"))
    both = said.unionByName(listed).filter(~F.col("ref").eqNullSafe(F.col("cm"))).groupBy("mail", "ref").agg(F.max("direct").alias("direct"))
    return one, both


def parents(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """(mail, parent) of every mail: the mail it answers, else the latest of those in its refs; null for a root.

    Circles of parents are opened at their smallest mail, which becomes a root.
    """
    one, said = _named(messages, refs)
    known = one.filter("cm is not null").select(F.col("cm").alias("ref"), F.col("mail").alias("named"), F.coalesce("date", F.lit(0)).alias("d"))
    best = said.join(known, "ref").filter("named <> mail").groupBy("mail").agg(F.max(F.struct("direct", "d", "named"))["named"].alias("parent"))
    pointers = cut(one.select("mail").join(best, "mail", "left"))
    # mails that still point somewhere after more steps than there are mails go round in a circle
    reach = pointers.filter("parent is not null").select("mail", F.col("parent").alias("to"), F.least("mail", "parent").alias("least"))
    for _ in range(max(1, pointers.count()).bit_length()):
        far = reach.select(F.col("mail").alias("to"), F.col("to").alias("next"), F.col("least").alias("l"))
        reach = cut(reach.join(far, "to").select("mail", F.col("next").alias("to"), F.least("least", "l").alias("least")))
        if reach.isEmpty():
            return pointers
    # now each of them points into its circle, whose smallest mail it has met on its way, or one before the circle
    inside = reach.select(F.col("to").alias("mail")).distinct()
    opened = inside.join(reach, "mail").filter("mail = least").select("mail", F.lit(True).alias("o"))
    return pointers.join(opened, "mail", "left").select("mail", F.when(F.col("o").isNull(), F.col("parent")).alias("parent"))


def paths(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """(leaf, position, message_id): the path from the root to every mail that none answers, position counting from 1.

    Depths and ancestors come from pointers that double their reach each round; the ancestor at each distance is then
    put together from the pointers of that distance in binary, so no path is gathered and no round count grows with
    more than the logarithm of the depth.
    """
    up = parents(messages, refs)
    levels = [cut(up.filter("parent is not null").select("mail", F.col("parent").alias("to"), F.lit(1).cast("bigint").alias("d")))]
    total = levels[0]
    reach = levels[0]
    while True:
        far = reach.select(F.col("mail").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"))
        reach = cut(reach.join(far, "to", "left").select("mail", F.coalesce("next", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("next").isNotNull().alias("on")))
        total = reach.select("mail", "to", "d")
        moved = reach.filter("on").select("mail", "to", "d")
        if moved.isEmpty():
            break
        step = 2 ** len(levels)
        levels.append(cut(moved.filter(F.col("d") == step)))
        reach = total
    leaves = up.select("mail").join(up.filter("parent is not null").select(F.col("parent").alias("mail")).distinct(), "mail", "left_anti")
    depth = leaves.join(total.select("mail", "d"), "mail", "left").select(F.col("mail").alias("leaf"), F.coalesce("d", F.lit(0)).cast("bigint").alias("depth"))
    at = depth.select("leaf", "depth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("depth"))).alias("dist")).withColumn("mail", F.col("leaf"))
    for k, level in enumerate(levels):
        hop = level.select("mail", F.col("to").alias("next"))
        at = at.join(hop, "mail", "left").withColumn("mail", F.when(F.col("dist").bitwiseAND(F.lit(1 << k)) != 0, F.col("next")).otherwise(F.col("mail"))).drop("next")
    return at.select("leaf", (F.col("depth") - F.col("dist") + 1).cast("int").alias("position"), F.col("mail").alias("message_id"))
