"""Threading: who answers whom, by Message-IDs and, failing that, by subject; of the whole index or of new rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.mids import clean_mid
from postloom.functions.text import normalize_subject
from postloom.plans.components import connected_components
from postloom.plans.lineage import cut

DAY = 86_400_000
WINDOW, SPAN, SHORTEST = 60 * DAY, 120 * DAY, 4
# Subjects that are too generic to join conversations on.
GENERIC = (
    "hallo", "hello", "hi", "test", "frage", "question", "info", "anfrage", "termin", "danke", "thanks", "no subject", "(no subject)", "kein betreff", "(kein betreff)", "fyi", "update",
    "rechnung", "invoice",
)


def is_reply(subject: Column) -> Column:
    """Whether the subject has a prefix or a tag that its normal form has not."""
    bare = F.lower(normalize_subject(subject))
    return F.coalesce((bare != "") & (bare != F.lower(F.trim(subject))), F.lit(False))


def subject_topic(subject: Column) -> Column:
    """The normal form of a subject by which conversations may be joined; null for short and generic ones."""
    bare = F.lower(normalize_subject(subject))
    return F.when((F.length(bare) >= SHORTEST) & ~bare.isin(*GENERIC), bare)


def participants(messages: DataFrame, addresses: DataFrame, identities: DataFrame) -> DataFrame:
    """(id, person, wrote): everyone of each mail but the owners, and whether they are its sender."""
    own = identities.select(F.lower(F.trim("addr")).alias("person")).filter("person is not null").distinct()
    named = addresses.select(F.col("message_id").alias("id"), F.lower(F.trim("addr")).alias("person"), F.lit(False).alias("wrote"))
    senders = messages.select("id", F.lower(F.trim("from_addr")).alias("person"), F.lit(True).alias("wrote"))
    every = named.unionByName(senders).filter("person is not null and person <> ''").groupBy("id", "person").agg(F.max("wrote").alias("wrote"))
    return every.join(own, "person", "left_anti")


def nearest_by_subject(rows: DataFrame, who: DataFrame) -> DataFrame:
    """(id, target): for each row that ``seeks`` the nearest mail of its topic in reply position within 60 days.

    rows: id, topic, date, reply, seeks; who: id, person, wrote.  In reply position are two mails of which the sender
    of one takes part in the other.  A mail that is no reply looks only for later replies that seek as well.
    Mails meet neighbours in time through windows over (topic, person) in slices of time, never as pairs.
    """
    base = rows.filter("topic is not null and date is not null").join(who, "id")
    slot, span = F.floor(F.col("date") / (720 * DAY)), 720 * DAY
    sliced = base.withColumn("slot", F.explode(F.array_distinct(F.array(slot, F.floor((F.col("date") - WINDOW) / span), F.floor((F.col("date") + WINDOW) / span)))))
    w = Window.partitionBy("topic", "person", "slot").orderBy("date", "id")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    this = F.struct("date", "id")
    later = F.col("reply") & F.col("seeks")
    seen = sliced.select(
        "id", "date", "reply", "seeks", "wrote",
        F.last(F.when(F.col("wrote"), this), ignorenulls=True).over(before).alias("sender_before"), F.first(F.when(F.col("wrote"), this), ignorenulls=True).over(after).alias("sender_after"),
        F.last(this).over(before).alias("any_before"), F.first(this).over(after).alias("any_after"),
        F.first(F.when(F.col("wrote") & later, this), ignorenulls=True).over(after).alias("reply_sender_after"), F.first(F.when(later, this), ignorenulls=True).over(after).alias("reply_after"),
    ).filter("seeks")
    wrote = lambda c: F.when(F.col("wrote"), F.col(c))
    for_reply = F.array("sender_before", "sender_after", wrote("any_before"), wrote("any_after"))
    for_new = F.array("reply_sender_after", wrote("reply_after"))
    one = seen.select("id", "date", F.explode(F.array_compact(F.when(F.col("reply"), for_reply).otherwise(for_new))).alias("c"))
    gap = F.abs(F.col("c.date") - F.col("date"))
    earlier = F.struct(F.col("c.date"), F.col("c.id")) < F.struct("date", "id")
    order = F.struct(gap.alias("gap"), F.col("c.date").alias("d"), F.when(earlier, -F.col("c.id")).otherwise(F.col("c.id")).alias("i"), F.col("c.id").alias("target"))
    return one.filter(gap <= WINDOW).groupBy("id").agg(F.min(order)["target"].alias("target"))


def _rows(messages: DataFrame) -> DataFrame:
    date = F.when(F.col("date") != 0, F.col("date"))
    return messages.select("id", clean_mid(F.col("mid")).alias("mail"), clean_mid(F.col("in_reply_to")).alias("answers"), date.alias("date"), subject_topic(F.col("subject")).alias("topic"), is_reply(F.col("subject")).alias("reply"))


def _named(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, mail): what every row names in refs or in_reply_to."""
    return refs.select(F.col("message_id").alias("id"), clean_mid(F.col("ref_mid")).alias("mail")).unionByName(rows.select("id", F.col("answers").alias("mail"))).filter("mail is not null").distinct()


def assign_threads(messages: DataFrame, refs: DataFrame, addresses: DataFrame, identities: DataFrame) -> DataFrame:
    """id, thread: the smallest id of the conversation of every row.

    Rows of one Message-ID, and rows of which one names the other, belong together.  A mail whose own references lead
    nowhere joins the nearest mail of the 60 days around it with the same subject in reply position (if it is no reply,
    only a later reply that leads nowhere too), unless the two conversations would span more than 120 days.  Spans are
    those before any joining by subject, so the result does not depend on an order of rows.
    """
    rows = cut(_rows(messages))
    heads = rows.filter("mail is not null").groupBy("mail").agg(F.min("id").alias("head"))
    copies = rows.join(heads, "mail").select(F.col("id").alias("a"), F.col("head").alias("b"))
    answers = cut(_named(rows, refs).join(heads, "mail").select(F.col("id").alias("a"), F.col("head").alias("b")))
    sure = copies.unionByName(answers)
    first = connected_components(sure)
    label = cut(rows.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"))
    led = answers.select(F.col("a").alias("id")).distinct().withColumn("led", F.lit(True))
    seeking = label.join(led, "id", "left").select("id", "topic", "date", "reply", F.col("led").isNull().alias("seeks"))
    near = nearest_by_subject(seeking, participants(messages, addresses, identities))
    edges = _within_span(near, label)
    every = connected_components(sure.unionByName(edges))
    return rows.select("id").join(every.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("thread"))


def _within_span(near: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) of (id, target) whose parts differ and together span no more than SPAN; label: id, date, part."""
    spans = label.groupBy("part").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    parts = label.select("id", "part")
    both = near.join(parts, "id").join(parts.select(F.col("id").alias("target"), F.col("part").alias("other")), "target").filter("part <> other")
    both = both.join(spans, "part").join(spans.select(F.col("part").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "other")
    return both.filter(F.greatest("hi", "hi2") - F.least("lo", "lo2") <= SPAN).select(F.col("id").alias("a"), F.col("target").alias("b"))


def assign_new(messages: DataFrame, new: DataFrame, refs: DataFrame, addresses: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threading of the rows in ``new`` (id) only: (id, thread) of every row whose thread changes, and the unresolved ones.

    ``messages`` holds all rows, with the thread_id they have so far.  New rows meet the threads of the mails they name,
    of the mails that name them and of their copies; those that name nothing go by subject.  Threads that a new row
    ties together become one, named by its smallest id.  The second result (id) are new rows whose references lead
    nowhere yet: if there are any, ``assign_threads`` should run once all rows are there.
    """
    rows = cut(_rows(messages).join(messages.select("id", "thread_id"), "id"))
    fresh = cut(new.select("id").distinct())
    mine = rows.join(fresh, "id")
    old = rows.join(fresh, "id", "left_anti").filter("thread_id is not null")
    # a node is a thread, or a new row that has none yet, by its own id
    node = old.select("id", "mail", F.col("thread_id").alias("node")).unionByName(mine.select("id", "mail", F.col("id").alias("node")))
    named = _named(rows, refs)
    says = named.join(fresh, "id").join(node.select("mail", "node"), "mail").select(F.col("id").alias("a"), F.col("node").alias("b"))
    said = named.join(mine.filter("mail is not null").select("mail", F.col("id").alias("b")), "mail").join(node.select("id", F.col("node").alias("a")), "id").select("a", "b")
    same = mine.filter("mail is not null").select("mail", F.col("id").alias("a")).join(node.select("mail", F.col("node").alias("b")), "mail").select("a", "b")
    sure = cut(says.unionByName(said).unionByName(same).filter("a <> b").distinct())
    met = sure.select(F.col("a").alias("id")).unionByName(sure.select(F.col("b").alias("id"))).distinct()
    naming = named.select("id").distinct()
    loose = mine.join(naming, "id", "left_anti").join(met, "id", "left_anti").select("id", F.lit(True).alias("seeks"))
    # replies without references seek as well, as candidates of mails that are no replies
    candidates = rows.join(loose, "id", "left").join(naming.withColumn("n", F.lit(True)), "id", "left").select("id", "topic", "date", "reply", (F.col("seeks").isNotNull() | F.col("n").isNull()).alias("seeks"))
    near = nearest_by_subject(candidates, participants(messages, addresses, identities)).join(loose.select("id"), "id")
    label = node.select("id", F.col("node").alias("part")).join(rows.select("id", "date"), "id")
    pairs = _within_span(near, label).join(node.select(F.col("id").alias("b"), "node"), "b").select("a", F.col("node").alias("b"))
    merged = connected_components(sure.unionByName(pairs))
    thread = node.join(merged.select(F.col("node"), "component"), "node", "left").select("id", F.coalesce("component", "node").alias("thread"))
    changed = thread.join(messages.select("id", "thread_id"), "id").filter(~F.col("thread").eqNullSafe(F.col("thread_id"))).select("id", "thread")
    unresolved = naming.join(fresh, "id").join(says.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    return changed, unresolved
