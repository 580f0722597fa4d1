"""Survivors, neighbours and names."""

import random

import numpy as np
import pytest

from postloom.llm import names, neighbours, survivor

ROWS = "id long, mid string, from_addr string, date long, subject string, from_name string, body string, content_state string, updated_at long, group_id string"


def definition(rows):
    """What survives, by sorting whole groups."""
    import json
    import re

    groups, usable = {}, lambda t: t is not None and t.strip() != "" and t.strip().lower() not in survivor.STAND_INS and not re.search(r"=\?[\w-]+\?[QqBb]\?|�|[ÂÃ][\x80-\xBF]", t)
    for r in rows:
        clean = re.sub(r"[\s<>]+", "", r["mid"] or "").lower()
        key = clean if clean and not clean.startswith("no-id-") else json.dumps([r["from_addr"], r["date"], r["subject"]])
        groups.setdefault(key, []).append(r)
    out = set()
    for g in groups.values():
        if len(g) > 1:
            for f in survivor.FIELDS:
                ok = [r for r in g if (bool(r[f]) if f == "date" else usable(r[f]))]
                rank = lambda r: (-(survivor.TRUST[::-1].index(r["content_state"]) + 1 if r["content_state"] in survivor.TRUST else 0), -(r["updated_at"] if r["updated_at"] is not None else -(2**62)), r["id"])
                if ok:
                    out.add((min(r["id"] for r in g), f, min(ok, key=rank)["id"]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_survivors_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    mids = [None, "", "a@x", "<A@x>", " a@\r\n x", "b@x", "no-id-1@y", "no-id-2@y", "hot@x"]
    rows = [
        dict(id=i, mid=rng.choice(mids) if i % 3 else "hot@x", from_addr=rng.choice(["p@x", None]), date=rng.choice([None, 0, 5, 6]), subject=rng.choice(["s", None, "n/a", "=?UTF-8?Q?x?=", "RÃ¼ck"]),
             from_name=rng.choice([None, " ", "-", "Anna", "Bernd"]), body=rng.choice([None, "", "text", "(leer)"]), content_state=rng.choice([*survivor.TRUST, None, "odd"]), updated_at=rng.choice([None, 1, 2, 3]), group_id="z")
        for i in range(150)
    ]
    columns = [c.split()[0] for c in ROWS.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ROWS)
    got = [tuple(r) for r in survivor.survivors(df).collect()]
    assert len(got) == len(set(got)) and set(got) == definition(rows)
    records = {r["group_id"]: r for r in survivor.build_records(df).collect()}
    by_id = {r["id"]: r for r in rows}
    assert all(records[g][f] == by_id[s][f] for g, f, s in got)
    assert survivor.survivors(df.limit(0)).count() == 0


VECTORS = "message_id long, model string, dim int, vec array<float>, id int"


def exact(rows, k=5):
    out = {}
    for model in {r[1] for r in rows}:
        sound = sorted([r for r in rows if r[1] == model and r[3] is not None and len(r[3]) == r[2] and all(v is not None and np.isfinite(v) for v in r[3]) and any(r[3])])
        if sound:
            x = neighbours.unit(np.array([np.float32(r[3]) for r in sound]))
            s = np.round(x @ x.T, 10)
            for i, r in enumerate(sound):
                others = sorted((-s[i, j], q[0]) for j, q in enumerate(sound) if j != i)
                out[r[0]] = {o for _, o in others[:k]}
    return out


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(size=8).round(3).tolist() for _ in range(120)]
    rows = [(i, "m", 8, base[i % 120] if i < 150 else base[7], 0) for i in range(200)]
    rows += [(300 + i, "n", 4, rng.normal(size=4).tolist(), 0) for i in range(3)] + [(400, None, 2, [1.0, 0.0], 0), (401, None, 2, [2.0, 0.0], 0)]
    rows += [(500, "m", 8, None, 0), (501, "m", 8, [0.0] * 8, 0), (502, "m", 8, [1.0] * 7, 0), (503, "m", 8, [float("nan")] * 8, 0), (504, "m", 8, [None] * 8, 0), (505, "m", None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert got == {k: v for k, v in exact(rows).items() if v}
    assert neighbours.pairs(df.limit(0)).count() == 0


def test_recall_of_learned_partitions(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(25, 24))
    x = (centres[rng.integers(0, 25, 2500)] + 0.6 * rng.normal(size=(2500, 24))).astype(np.float32)
    rows = [(i, "m", 24, v.tolist(), 0) for i, v in enumerate(x)]
    want = exact(rows)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS), probes=6, part_rows=120, block_rows=90).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert all(len(got[i]) == 5 for i in want)
    assert np.mean([len(got[i] & want[i]) / 5 for i in want]) > 0.93


def test_parts_are_balanced():
    x = neighbours.unit(np.random.default_rng(1).normal(size=(1000, 6)))
    part = neighbours.balanced_parts(x, neighbours.neighbour_graph(x), 7)
    assert np.bincount(part, minlength=7).max() <= np.ceil(1.05 * 1000 / 7)


SAME = [
    ("Anneliese Plauungiak", ["Plauungiak, Anneliese", "A. Plauungiak", "Liesl Plauugniak", "ANNELIESE PLAUUNGIAK", "'Anneliese Plauungiak'", "Dr. Anneliese Plauungiak", "anneliese.plauungiak", "Anneliese R. Plauungiak", "Anneliese Plauungiak via Alle"], "a.plauungiak@firma.example"),
    ("Jürgen Fölker", ["Juergen Foelker", "Jurgen Folker", "JÃ¼rgen FÃ¶lker", "=?UTF-8?Q?J=C3=BCrgen_F=C3=B6lker?=", "Jürgen Fölker (Firma)", "Jürgen  Fölker"], "foelkerj@firma.example"),
    ("Quarznex Holzhandel AG", ["Quarznex Holzh. AG", "Holzhandel Quarznex AG", "QuarznexHolzhandel AG", "Fa. Quarznex Holzhandel", "quarznex holzhandel ag", "Quarznex (Holzhandel)", "Quarznex-Holzhandel Aktiengesellschaft"], "kontakt@quarznexholz.example"),
]


def test_spellings(spark):
    rows = []
    for name, others, addr in SAME:
        rows += [(1, "from", name, addr)] * 5 + [(2, "to", o, addr) for o in others]
    rows += [(3, "from", n, "office@firma.example") for n in ("Petra Plauungiak", "Karl Unverwandt", "Karla Unverwandt")] + [(4, "to", n, "a.plauungiak@firma.example") for n in ("", " ", None, "n/a", "a.plauungiak@firma.example")]
    rows += [(7, "to", f"{g} {f}", f"{g}.{f}@firma.example".lower()) for g in ("Karl", "Karla") for f in ("Adam", "Bergner", "Clausen", "Dorfer", "Ehlers", "Funke", "Gruber", "Hansen")]
    rows += [(5, "cc", "Quarznex Systeme AG", "kontakt@quarznexsyst.example"), (6, "cc", "Jürgen Fölker", None)]
    addresses = spark.createDataFrame([(*r, "x") for r in rows], "message_id long, role string, name string, addr string, entity string")
    messages = spark.createDataFrame([(1, "Jürgen Fölker", "foelkerj@firma.example", "q")], "id long, from_name string, from_addr string, name string")
    got = {tuple(r) for r in names.pairs(addresses, messages).collect()}
    want = set()
    for name, others, _ in SAME:
        group = sorted({name, *others})
        want |= {(a, b) for i, a in enumerate(group) for b in group[i + 1 :]}
    assert got == want
    assert names.pairs(addresses.limit(0), messages.limit(0)).count() == 0


def found_names(spark, rows):
    """The pairs of (name, address) rows, each row twice."""
    addresses = spark.createDataFrame([(i, "to", *r) for i, r in enumerate(rows + rows)], "message_id long, role string, name string, addr string")
    return {tuple(r) for r in names.pairs(addresses, spark.createDataFrame([], "from_name string, from_addr string")).collect()}


def test_spellings_of_tokens_frequent_elsewhere(spark):
    letters = [a + b for a in "bdfgklmnp" for b in "aeiouyzx"]
    others = [(f"Tor{x}win Fölker", f"t{i}.foelker@firma{i}.example") for i, x in enumerate(letters)]
    others += [(f"Quarznex {x.upper()}wolt{x} KG", f"kontakt@f{i}.example") for i, x in enumerate(letters)] + [(f"Holzhandel {x.upper()}rimp{x} KG", f"kontakt@g{i}.example") for i, x in enumerate(letters)]
    groups = [(["Anna Fölker", "A. Fölker", "Fölker, A."], "a.foelker@firma.example"), (["Hans Fölker", "Johannes Fölker"], "h.foelker@firma.example"), (["Quarznex Holzh. KG", "Quarznex Holzhandel KG"], "kontakt@firma.example")]
    got = found_names(spark, others + [(n, addr) for group, addr in groups for n in group])
    assert got == {(a, b) for group, _ in groups for a in group for b in group if a < b}


def test_forms_of_given_names_in_a_shared_mailbox(spark):
    families = ("Adam", "Bergner", "Clausen", "Dorfer", "Ehlers", "Funke", "Gruber", "Hansen", "Imhoff")
    both = [(f"{g} {f}", f"j.{f.lower()}@firma.example") for f in families for g in ("Jon", "Jonathan")]
    own = [(f"{g} {f}", f"{g}.{f}@firma.example".lower()) for f in families[:3] for g in ("Karl", "Karla")]
    office = [(f"{g} Unverwandt", "office@firma.example") for g in ("Jon", "Jonathan", "Karl", "Karla")]
    # many bear each form, but the same people; few bear each form, but different people
    assert found_names(spark, both + own + office) == {(f"Jon {f}", f"Jonathan {f}") for f in (*families, "Unverwandt")}


def test_near():
    assert names.near("krause", "kruase") and names.near("krause", "kraus") and names.near("krause", "krausse") and names.near("goettel", "gottel") and not names.near("krause", "kurase2")
    assert not names.near("krause", "krxxse") and names.near("a", "a") and not names.near("ab", "ba2")
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcxyz") for _ in range(7))
        i = rng.randrange(7)
        assert names.near(w, w[:i] + w[i + 1 :]) and names.near(w, w[:i] + "q" + w[i:]) and names.near(w, w[:i] + "q" + w[i + 1 :])


def test_assignment_of_long_names_is_optimal():
    """Names of more than seven tokens against all orders of a shorter one, and against the search over sets."""
    rng = random.Random(4)
    words = "anna maria muster beispiel nord holz werke bau gruppe verein haus a m b".split()
    for _ in range(30):
        a, b = ([rng.choice(words) for _ in range(rng.randrange(1, 8))] for _ in range(2))
        if len(a) > len(b):
            a, b = b, a
        assert abs(sum(c for *_, c in names._augment(a, b)) - sum(c for *_, c in names.assign(a, b))) < 1e-9
    long = "verein der freunde des alten hauses am nord see".split()
    other = ["freunde", "verein", "hauses", "altn", "nord", "see", "der", "des", "am"]
    assert len(names.assign(long, other)) == 9 and names.matches(long, other[::-1], True, "")[0] == 1


def test_recall_of_parts_of_parts(spark):
    """Two levels of parts against brute force: clustered vectors, 1 part in 20 searched."""
    rng = np.random.default_rng(5)
    n, d = 24_000, 32
    centres = rng.normal(size=(400, d))
    x = (centres[rng.integers(0, 400, n)] + 0.45 * rng.normal(size=(n, d))).astype(np.float32)
    df = spark.createDataFrame([(i, "m", d, v.tolist()) for i, v in enumerate(x)], "message_id long, model string, dim int, vec array<float>").repartition(8)
    got = {}
    for r in neighbours.nearest(df, part_rows=100).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert len(got) == n and all(len(v) == 5 for v in got.values())
    u = neighbours.unit(x)
    asked = np.arange(0, n, 40)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    want = np.argpartition(-s, 4, axis=1)[:, :5]
    recall = np.mean([len(got[int(a)] & set(w.tolist())) / 5 for a, w in zip(asked, want)])
    print("recall", recall)
    assert recall >= 0.95
