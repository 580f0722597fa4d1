"""Variant spellings of names typed by people: which spellings mean the same person or organisation.

Names are reduced to folded tokens (decoded, without titles, relays, affiliations and legal forms).  A
symmetric-delete index on tokens brings together, within one mailbox (one domain for organisations), the names that
share a token up to one edit.  Their tokens are then aligned by optimal assignment, in which a token may also match
its initial, its abbreviation or a joined spelling.  In a mailbox whose address carries the family name, one family
name is one person, whatever form of the given name is used.  The groups of the mailboxes are joined over all
mailboxes by their full token keys; spellings with initials, and short forms that are used for several given names,
are members of their groups but join nothing.

Only spellings of one mailbox that share a token meet, each list of tokens once however many spellings have it, and
groups become pairs only in the result, so names that are frequent over all mailboxes and mailboxes with a tenth of
all rows cost no more than others.

Defined results: null and blank names, stand-ins and addresses belong to no group; repeated rows count once per
spelling; names without an address are grouped by their full token key alone; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import quopri
import re
import unicodedata
from base64 import b64decode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.survivor import STAND_INS
from postloom.plans.components import connected_components
from postloom.plans.lineage import cut

# Titles and forms of address, legal forms, words that open a relay.
TITLES = frozenset("dr prof professor ing dipl mag herr frau hr fr mr mrs ms miss mme mlle monsieur madame".split())
LEGAL = frozenset("gmbh ag kg ohg gbr ug ev e.v se ltd limited inc llc plc corp sarl sa sas aktiengesellschaft gesellschaft mbh co cokg eg eingetr eingetragener verein s.a.r.l g.m.b.h a.g k.g s.a llp bv nv".split())
FIRM = frozenset("fa firma fa. maison company".split())
RELAY = re.compile(r"\s+(?:via|über|ueber|par|per|on behalf of|im auftrag von)\s+.*$", re.I)
WORD = re.compile(r"=\?([A-Za-z0-9_-]+)\?([QqBb])\?([^?]*)\?=")
# Two forms are names of their own if they meet in less than this share of the mailboxes by family name that have the rarer one.
_APART = 0.1


def decode_words(text: str) -> str:
    """Encoded words read, and UTF-8 that was read as a one-byte set put right (as often as it was done)."""

    def word(m: re.Match) -> str:
        try:
            raw = b64decode(m[3] + "==") if m[2] in "Bb" else quopri.decodestring(m[3].replace("_", " "))
            return raw.decode(m[1], "replace")
        except (LookupError, ValueError):
            return m[0]

    text = WORD.sub(word, re.sub(r"\?=\s+=\?", "?==?", text))
    for _ in range(2):
        if not re.search(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]", text):
            break
        for charset in ("latin-1", "cp1252"):
            try:
                text = text.encode(charset).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            mixed = b"".join(c.encode("cp1252") if _fits(c) else c.encode("latin-1", "replace") for c in text)
            fixed = mixed.decode("utf-8", "replace")
            if "�" in fixed:
                break
            text = fixed
    return unicodedata.normalize("NFC", text)


def _fits(c: str) -> bool:
    try:
        c.encode("cp1252")
        return True
    except UnicodeError:
        return False


def fold(text: str) -> str:
    """Lower case without accents; umlauts as they are transcribed."""
    text = unicodedata.normalize("NFC", text.lower())
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("æ", "ae"), ("ø", "oe"), ("œ", "oe"), ("ł", "l")):
        text = text.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def skeleton(text: str) -> str:
    """Folded, with umlauts, their transcriptions and the bare vowels fallen together."""
    return _UMLAUT.sub("", fold(text))


_UMLAUT = re.compile(r"(?<=[aou])e|(?<=s)s+")


def parse(name: str | None) -> tuple[bool, list[str]]:
    """(whether it has a legal form, tokens); no tokens for stand-ins, blanks and addresses."""
    text = decode_words(name or "").replace(" ", " ")
    text = re.sub(r"[​-‏﻿­]", "", text).strip()
    if text.lower() in STAND_INS or "@" in text:
        return False, []
    text = RELAY.sub("", text)
    text = re.sub(r"^[\s'\"‘’“”„«»<]+|[\s'\"‘’“”«»>,;]+$", "", text)
    aside = re.search(r"\(([^()]*)\)", text)
    if aside:
        before = text[: aside.start()].split()
        text = text[: aside.start()] + (" " + aside[1] if len(before) == 1 else "") + text[aside.end() :]
    if " " not in text.strip() and re.fullmatch(r"[^\W\d_]+[._][^\W\d_]+\d*", text):
        text = re.sub(r"[._\d]", " ", text)
    text = re.sub(r"(?<=[a-zäöüßé])(?=[A-ZÄÖÜ][a-zäöüß])", " ", text)
    legal, tokens = False, []
    for raw in re.split(r"[\s,;/+&|]+", text.lower()):
        bare = raw.strip(".()\"'’")
        if raw in LEGAL or bare in LEGAL or fold(bare) in LEGAL or bare.replace(".", "") in LEGAL:
            legal = True
        elif bare in FIRM or raw in FIRM:
            legal = True
        elif bare and bare not in TITLES:
            tokens += [fold(t) for t in re.split(r"[-.'’_]+", bare) if t]
    return legal, [t for t in tokens if t]


def near(a: str, b: str) -> bool:
    """Equal up to one insertion, deletion, substitution or exchange of neighbours, with or without transcriptions."""
    return _one_edit(a, b) or _one_edit(_UMLAUT.sub("", a), _UMLAUT.sub("", b))


def _one_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def _cost(a: str, b: str) -> float:
    if a == b or _UMLAUT.sub("", a) == _UMLAUT.sub("", b):
        return 0.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 4 and near(a, b):
        return 1.0
    if len(short) == 1:
        return 0.6 if long[0] == short else 9.0
    if long.startswith(short):
        return 0.7
    rest = iter(long)
    if long[0] == short[0] and all(c in rest for c in short) and 2 * len(short) <= len(long):
        return 0.8  # letters of the word in order, as in intl
    return 9.0


def assign(a: list[str], b: list[str]) -> list[tuple[int, int, float]]:
    """Optimal assignment of the shorter list of tokens into the longer one: (place in a, place in b, cost)."""
    if len(a) > len(b):
        return [(j, i, c) for i, j, c in assign(b, a)]
    if len(b) > 7:
        return _augment(a, b)
    best: dict[int, tuple[float, list]] = {0: (0.0, [])}
    for i, x in enumerate(a):
        nxt: dict[int, tuple[float, list]] = {}
        for used, (total, done) in best.items():
            for j, y in enumerate(b):
                if not used >> j & 1:
                    c = total + (w := _cost(x, y))
                    k = used | 1 << j
                    if k not in nxt or c < nxt[k][0]:
                        nxt[k] = (c, [*done, (i, j, w)])
        best = nxt
    return min(best.values(), key=lambda v: v[0])[1]


def _augment(a: list[str], b: list[str]) -> list[tuple[int, int, float]]:
    """The same by shortest augmenting paths with potentials, for long names; time grows with the cube of their length."""
    n, m = len(a), len(b)
    cost = [[_cost(x, y) for y in b] for x in a]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, way, seen = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            seen[j] = True
            row, step, nxt = owner[j], float("inf"), 0
            for k in range(1, m + 1):
                if not seen[k]:
                    c = cost[row - 1][k - 1] - u[row] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < step:
                        step, nxt = least[k], k
            for k in range(m + 1):
                if seen[k]:
                    u[owner[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = nxt
            if not owner[j]:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    return sorted((owner[k] - 1, k - 1, cost[owner[k] - 1][k - 1]) for k in range(1, m + 1) if owner[k])


def matches(a: list[str], b: list[str], org: bool, family: str) -> tuple[int, str, str]:
    """How two token lists of one mailbox agree, and the two forms of a given name on which that hangs.

    0: not; 1: they mean the same; 2: the same, as the family name in the address agrees; 3: the same, if the two
    forms are known to belong together; 4: the same, unless both forms are names of their own.  family: the part of the address that may be a family name.
    """
    ja, jb = _UMLAUT.sub("", "".join(a)), _UMLAUT.sub("", "".join(b))
    if ja == jb or sorted(a) == sorted(b) or ((org or len(a) != len(b)) and len(ja) >= 8 and near(ja, jb)):
        return 1, "", ""
    done = assign(a, b)
    good = [(a[i], b[j], c) for i, j, c in done if c <= 1 and (org or c != 0.8)]
    anchors = [(x, y) for x, y, c in good if c in (0.0, 1.0) and min(len(x), len(y)) >= 4]
    if not anchors:
        return 0, "", ""
    shorter = min(len(a), len(b))
    bad = [(a[i], b[j]) for i, j, c in done if c > 1 or (c == 0.8 and not org)]
    edits = sum(c == 1.0 for _, _, c in good)
    if org:
        return int(not bad and edits <= 1), "", ""
    held = family and any(near(s, family) or near(t, family) or (len(s) >= 5 and (s in family or t in family)) for s, t in anchors)
    if not bad and edits <= 2:
        # what is left over in the longer name: middle initials and second parts of double names
        weak = any(c in (0.6, 0.7) or min(len(x), len(y)) < 4 for x, y, c in good)
        if shorter < 2 or not (len(anchors) >= 2 or weak):
            return 0, "", ""
        apart = [(x, y) for x, y, c in good if c in (0.7, 1.0)]
        return (4, *sorted(apart[0])) if len(apart) == 1 and not held else (1, "", "")
    if len(bad) != 1 or shorter < 2:
        return 0, "", ""
    x, y = sorted(_UMLAUT.sub("", t) for t in bad[0])
    return (2 if held else 3), x, y


def family_part(address: str | None) -> str:
    """The long last part of the local part, where a family name stands if there is one; empty for office@ and such."""
    local = fold((address or "").partition("@")[0].split("+")[0])
    parts = [p for p in re.split(r"[._-]+", re.sub(r"\d+(?:p\d+)?$", "", local)) if p]
    long = [p for p in parts if len(p) >= 4]
    return long[-1] if long else ""


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        got = [matches(x, y, o, "" if o else family_part(s)) for x, y, o, s in zip(d["t1"], d["t2"], d["org"], d["address"])]
        out = pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
            names=["n1", "n2", "how", "f1", "f2"],
        )
        yield out.filter(pa.array([g[0] > 0 for g in got], pa.bool_()))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of names whose family name their address carries."""
    for b in batches:
        scopes, tokens = [], []
        for scope, name, address in zip(*(b.column(k).to_pylist() for k in range(3))):
            family = family_part(address)
            if family and any(len(t) >= 4 and (near(t, family) or (len(t) >= 5 and t in family)) for t in name):
                scopes += [scope] * len(name)
                tokens += name
        yield pa.RecordBatch.from_arrays([pa.array(scopes, pa.string()), pa.array(tokens, pa.string())], names=["scope", "token"])


def _apart(forms: DataFrame, occ: DataFrame) -> DataFrame:
    """(f1, f2): those forms that are used in mailboxes of one family name each, but hardly ever in the same ones."""
    used = cut(occ.filter("not org and address is not null").select("scope", "tokens", "address").mapInArrow(_held, "scope string, token string").distinct())
    uses = used.groupBy("token").agg(F.count(F.lit(1)).alias("u"))
    both = forms.join(uses.select(F.col("token").alias("f1"), F.col("u").alias("u1")), "f1").join(uses.select(F.col("token").alias("f2"), F.col("u").alias("u2")), "f2")
    # the mailboxes of the rarer form are looked through for the other one
    both = both.select("f1", "f2", F.expr("if(u1 <= u2, f1, f2)").alias("rare"), F.expr("if(u1 <= u2, f2, f1)").alias("other"), F.least("u1", "u2").alias("u"))
    met = both.join(used.select(F.col("token").alias("rare"), "scope"), "rare").join(used.select(F.col("token").alias("other"), "scope"), ["other", "scope"], "left_semi")
    met = met.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("m"))
    return both.join(met, ["f1", "f2"], "left").filter(F.coalesce("m", F.lit(0)) < _APART * F.col("u")).select("f1", "f2")


def groups(addresses: DataFrame, messages: DataFrame) -> DataFrame:
    """(name, entity): every spelling with the groups it belongs to; entities are arbitrary but stable numbers."""
    seen = (
        addresses.select("name", F.lower(F.trim("addr")).alias("address")).unionByName(messages.select(F.col("from_name").alias("name"), F.lower(F.trim("from_addr")).alias("address")))
        .filter("name is not null").groupBy("name", "address").agg(F.count(F.lit(1)).alias("n"))
    )
    seen = cut(seen)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(n) for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.bool_()), pa.array([t for _, t in got], pa.list_(pa.string()))], names=["name", "legal", "tokens"])

    parsed = cut(seen.select("name").distinct().mapInArrow(read, "name string, legal boolean, tokens array<string>").filter(F.size("tokens") > 0))
    # organisations: a legal form, a word that only stands beside legal forms, or the beginning of the domain
    words = parsed.select("name", "legal", F.explode("tokens").alias("token"))
    firm_words = words.filter(F.length("token") >= 5).groupBy("token").agg(F.max("legal").alias("l"), F.avg(F.col("legal").cast("int")).alias("share")).filter("l and share > 0.3").select("token")
    by_word = words.join(firm_words, "token", "left_semi").select("name").distinct()
    by_domain = (
        seen.filter("address like '%@%'").join(words.filter(F.length("token") >= 5), "name")
        .filter(F.expr("startswith(split_part(address, '@', 2), token)")).select("name").distinct()
    )
    orgs = parsed.filter("legal").select("name").union(by_word).union(by_domain).distinct().withColumn("org", F.lit(True))
    parsed = cut(parsed.join(orgs, "name", "left").select("name", "tokens", F.coalesce("org", F.lit(False)).alias("org")))

    scope = F.when(F.col("address").isNull(), F.concat(F.lit("n:"), F.col("name"))).when(F.col("org"), F.concat(F.lit("d:"), F.expr("split_part(address, '@', 2)"))).otherwise(F.concat(F.lit("a:"), F.col("address")))
    bare = F.transform(F.filter("tokens", lambda t: F.length(t) > 1), lambda t: F.regexp_replace(t, _UMLAUT.pattern, ""))
    node = F.xxhash64("scope", "name")
    occ = seen.join(parsed, "name").withColumn("scope", scope).groupBy("scope", "name").agg(F.sum("n").alias("n"), F.first("tokens").alias("tokens"), F.first("org").alias("org"), F.min("address").alias("address"))
    # a bare token key; none where initials leave only one real token
    occ = occ.withColumn("key", F.when((F.col("org") & (F.size(bare) == F.size("tokens"))) | (F.size(bare) >= 2), F.concat_ws(" ", F.array_sort(bare)))).withColumn("node", node)
    occ = cut(occ)

    # spellings of one list of tokens mean the same: the first of them stands for all in the index
    heads = occ.groupBy("scope", "tokens").agg(F.min_by("name", "node").alias("name"), F.min("node").alias("head"))
    same = occ.join(heads.select("scope", "tokens", "head"), ["scope", "tokens"]).filter("node <> head").select(F.col("head").alias("n1"), F.col("node").alias("n2"))
    # symmetric-delete index on every token of a mailbox, however frequent the token is elsewhere
    tok = heads.select("scope", "name", F.explode(F.array_distinct(F.concat("tokens", F.array(F.array_join("tokens", ""))))).alias("token")).filter(F.length("token") >= 4)

    def without_one(t: Column) -> Column:
        return F.concat(F.array(t), F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t)))))

    spread = F.array_distinct(F.concat(without_one(F.col("token")), without_one(F.regexp_replace("token", _UMLAUT.pattern, ""))))
    index = tok.withColumn("cut", F.explode(spread)).select("scope", "cut", "name").distinct()
    left, right = index.select("scope", "cut", F.col("name").alias("a")), index.select("scope", "cut", F.col("name").alias("b"))
    met = left.join(right, ["scope", "cut"]).filter("a < b").select("scope", "a", "b").distinct()
    side = occ.select("scope", "name", "tokens", "org", "address", "node").join(heads.select(F.col("head").alias("node")), "node", "left_semi")
    full = (
        met.join(side.select("scope", F.col("name").alias("a"), F.col("tokens").alias("t1"), F.col("node").alias("n1"), "org", "address"), ["scope", "a"])
        .join(side.select("scope", F.col("name").alias("b"), F.col("tokens").alias("t2"), F.col("node").alias("n2")), ["scope", "b"])
        .select("n1", "n2", "t1", "t2", "org", "address")
    )
    aligned = cut(full.mapInArrow(_align, "n1 bigint, n2 bigint, how int, f1 string, f2 string"))
    known = aligned.filter("how = 2").select("f1", "f2").distinct()
    # Karl and Karla in a mailbox of a firm: each has mailboxes without the other, so neither is the other misspelt
    apart = _apart(aligned.filter("how = 4").select("f1", "f2").distinct(), occ)
    likely = aligned.filter("how < 3").select("n1", "n2").unionByName(aligned.filter("how = 4").join(apart, ["f1", "f2"], "left_anti").select("n1", "n2"))
    linked = likely.unionByName(aligned.filter("how = 3").join(known, ["f1", "f2"], "left_semi").select("n1", "n2"))
    # what a head is linked to, the spellings it stands for are linked to as well
    stood = same.select(F.col("n1").alias("h"), F.col("n2").alias("member")).unionByName(heads.select(F.col("head").alias("h"), F.col("head").alias("member")))
    left_ = linked.join(stood.select(F.col("h").alias("n1"), F.col("member").alias("m1")), "n1").select(F.col("m1").alias("n1"), "n2")
    right_ = linked.join(stood.select(F.col("h").alias("n2"), F.col("member").alias("m2")), "n2").select("n1", F.col("m2").alias("n2"))
    linked = cut(left_.unionByName(right_).unionByName(same).distinct())

    whole = occ.filter("key is not null").select("node", "key", "org")
    firm = linked.join(whole.select(F.col("node").alias("n1")), "n1", "left_semi").join(whole.select(F.col("node").alias("n2")), "n2", "left_semi")
    inner = connected_components(firm.select(F.col("n1").alias("a"), F.col("n2").alias("b")))
    local = cut(whole.join(inner, "node", "left").select("node", "key", "org", F.coalesce("component", "node").alias("local")))
    # the leading spelling of a local group; other keys join groups only if they lead to one leading given name
    lead = local.join(occ.select("node", "n"), "node").groupBy("local", "key").agg(F.sum("n").alias("n")).groupBy("local").agg(F.max_by("key", F.struct("n", "key")).alias("lead"))
    keyed = local.join(lead, "local").select("local", "key", "lead", "org").distinct()
    odd = lambda c: F.array_except(F.split(c, " "), F.split("key" if c == "lead" else "lead", " "))
    forms = keyed.filter("key <> lead and not org").select(F.array_join(odd("key"), " ").alias("form"), F.array_join(odd("lead"), " ").alias("given")).filter("form <> '' and given <> ''").distinct()
    vague = forms.groupBy("form").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("form")
    joins = keyed.withColumn("form", F.array_join(odd("key"), " ")).join(vague.withColumn("v", F.lit(True)), "form", "left").filter("key = lead or v is null")
    by_key = joins.select(F.col("local").alias("a"), F.xxhash64(F.lit("key"), "key").alias("b"))
    entity = connected_components(by_key).select(F.col("node").alias("local"), F.col("component").alias("entity"))
    core = local.join(entity, "local").select("node", "entity")
    # spellings with initials belong to the groups they were aligned with
    both = linked.unionByName(linked.select(F.col("n1").alias("n2"), F.col("n2").alias("n1")))
    loose = occ.filter("key is null").select(F.col("node").alias("n1"))
    satellites = both.join(loose, "n1", "left_semi").join(core.select(F.col("node").alias("n2"), "entity"), "n2").select(F.col("n1").alias("node"), "entity")
    member = core.unionByName(satellites).join(occ.select("node", "name"), "node").select("name", "entity").distinct()
    # initials in mailboxes where nobody spells the name out: one another, within the mailbox
    lonely = both.join(loose, "n1", "left_semi").join(loose.select(F.col("n1").alias("n2")), "n2", "left_semi").join(satellites.select(F.col("node").alias("n1")), "n1", "left_anti")
    alone = connected_components(lonely.select(F.col("n1").alias("a"), F.col("n2").alias("b"))).join(occ.select("node", "name"), "node").select("name", F.col("component").alias("entity"))
    return member.unionByName(alone).distinct()


def pairs(addresses: DataFrame, messages: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair of different spellings of one group, in order of code points."""
    g = cut(groups(addresses, messages))
    return g.select("entity", F.col("name").alias("name_a")).join(g.select("entity", F.col("name").alias("name_b")), "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
