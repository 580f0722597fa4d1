"""Training of the tagger for personal information from labelled spans.

``python -m postloom.llm.pii_train MINUTES TABLES...`` reads the texts of a mail index as carriers, labels them by the
people the address table knows and by the written forms that numbers and addresses have in several countries, puts
generated names, numbers and addresses in the place of half of them, adds generated sentences, trains the tagger on a
bounded sample of the windows and writes pii_weights.npz beside this file.  What is generated comes from pii_forms:
its names are common ones of several countries and its numbers national forms, none of them taken from the tables.
Names and forms that pii_forms holds out are never trained on; recall on them is printed at the end, kind by kind.
The labels are made for training only; the operator itself knows no list of people.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd

from postloom.llm import pii_forms
from postloom.llm import pii_model as M
from postloom.llm.names import decode_words, family_part, fold, parse
from postloom.llm.pii import find, tagger, windows

WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: Windows of the texts that the tagger is trained on, at most.
SAMPLE_WINDOWS = 26_000
#: Generated sentences beside each batch of windows of the texts; they are new in every batch.
GENERATED = 20

_AT = r"\s?[(\[{]\s?(?:at|ät|arobase)\s?[)\]}]\s?"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|point)\s?[)\]}]\s?)"
EMAIL = re.compile(rf"[A-Za-z0-9][\w.+-]*(?:(?:@|{_AT})[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[a-z]{{2,12}}|\sat\s[a-z0-9-]+(?:\sdot\s[a-z0-9-]+)+)\b")
#: Telephone numbers: international, national with a leading 0, North American; 8 to 15 digits and no date.
PHONES = re.compile(
    r"(?<![\w./+#-])(?:(?:\+|00)[1-9]\d{0,2}(?:[ ./-]{0,2}\(0\))?(?:[ ./-]{0,2}\(?\d{1,8}\)?){1,6}|\(?0[1-9]\d{0,4}\)?(?:(?: / |[ ./-])\d{1,8}){1,5}|0[1-9]\d{8,10}|(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4})(?![\w-]|[./,]\d)"
)
DATE = re.compile(r"\d{2}([./])\d{2}\1(?:\d{4}|\d\d\b)")
#: Numbers of persons: tax, pension, social security, identity card and passport, in the forms of several countries.
IDS = re.compile(
    r"(?<![\w./+#-])(?:\d{2} \d{3} \d{3} \d{3}|\d{11}|\d{3}-\d{2}-\d{4}|\d \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|\d{13}(?:\d{2})?|\d{2} ?\d{6} ?[A-Z] ?\d{3}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|756\.\d{4}\.\d{4}\.\d\d|(?=[A-Z0-9]{9,10}(?!\w))[A-Z](?=[A-Z0-9]*[A-Z])\d(?:[A-Z0-9]){7,8})(?![\w-]|[./,]\d)"
)
STREET = r"(?:[A-ZÄÖÜ][\wäöüßéè.'’-]*|am|an|im|in|der|dem|den|zum|zur|du|de|des|la|le|les|à|aux|d'[\wÀ-ÿ]+|l'[\wÀ-ÿ]+|bis|[a-zà-ÿ]+)"
GERMAN = re.compile(r"(?:(?:Am|An|Im|In|Auf|Zum|Zur|Unter|Unterer|Oberer|Alte|Alter|Neue|Neuer|Hinter|Vor)(?: (?:der|dem|den))? )?(?:[A-ZÄÖÜ][\wäöüß.-]*)(?: [A-ZÄÖÜ][\wäöüß.-]*){0,2} \d{1,4}(?: ?[a-z]\b)?(?: ?[-–] ?\d{1,4}(?: ?[a-z])?)?,?[ \t]*(?:\r?\n(?:[>| \t]|[A-Z]{2}>)*)?\d{5} (?:Bad |Sankt |St\. )?[A-ZÄÖÜ][\wäöüß-]+(?: (?:am|an der|im|ob der) [A-ZÄÖÜ][\wäöü]+)?")
FRENCH = re.compile(r"\d{1,4}(?: ?(?:bis|ter|[a-c]))?,? (?:rue|avenue|av\.|boulevard|bd|chemin|impasse|place|allée|quai|route|cours|passage|square|sentier|ruelle)\b[^\n,]{2,40},[ \t]*(?:\r?\n(?:[>| \t]|[A-Z]{2}>)*)?\d{5} (?:Les |La |Le )?[A-ZÀ-Ý][\wÀ-ÿ-]+(?:[- ][A-ZÀ-Ý][\wÀ-ÿ-]+)*")
ENGLISH = re.compile(r"(?:Flat \d{1,3}[a-z]?, )?\d{1,4}[a-z]? (?:[A-Z][a-z]+ ){1,3}(?:Road|Street|Lane|Court|Wharf|Row|Quay|Avenue|Close|Way|Drive|Walk|Place|Square|Terrace|Rise|Grove|Green|Park|Parade|End|Gate|Vale|Gardens|Crescent|Mews|Yard|Hill|Rd|St)\b\.?,[ \t]*(?:\r?\n(?:[>| \t]|[A-Z]{2}>)*)?[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}(?:,? (?:[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}|[A-Z]{2} \d{5}))?")
TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def people(tables: list[str]) -> tuple[set[str], set[str]]:
    """Given names and family names, in lower case, of the people in the address tables.

    A name is a person's where the address carries its family name, as those of offices and lists do not.
    """
    given, family, firms, pairs = set(), set(), set(), {}
    for d in tables:
        seen = pd.read_parquet(f"{d}/addresses.parquet", columns=["name", "addr"]).dropna().drop_duplicates()
        for name, addr in seen.itertuples(index=False):
            text = re.sub(r"\(.*?\)|^(?:Dr|Prof)\. ", "", decode_words(name)).strip(" '\"")
            legal, tokens = parse(name)
            if legal or "@" in text or not text:
                firms.update(tokens)
                continue
            m = re.fullmatch(r"([^\W\d_]+(?:-[^\W\d_]+)?) +(?:[A-Z]\. )?([^\W\d_]{4,}(?:-[^\W\d_]+)?)(?: via .*)?", text)
            held = family_part(addr)
            if m and m[1][0].isupper() and held and (fold(m[2])[:5] in held or held in fold(m[2])):
                given.add(m[1].lower())
                family.update(x for x in [m[2].lower(), *m[2].lower().split("-")] if len(x) >= 5)
                pairs.setdefault(m[1].lower(), set()).add(m[2].lower())
    family -= {g for g, f in pairs.items() if len(f) >= 4} | firms
    return {g for g in given if len(g) >= 2 and len(pairs[g]) >= 2 and g not in family and g not in firms}, family


def label(text: str, given: set[str], family: set[str]) -> list[tuple[int, int, str]]:
    """Spans of personal information in a text of the training tables."""
    taken: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))

    for kind, pattern in (("email", EMAIL), ("address", GERMAN), ("address", FRENCH), ("address", ENGLISH), ("id_number", IDS), ("phone", PHONES)):
        for m in pattern.finditer(text):
            a = m.start() + (1 if kind == "phone" and text[m.start()] == "(" else 0)
            if kind != "phone" or (8 <= sum(map(str.isdigit, m[0])) <= 15 and not DATE.match(m[0])):
                add(a, m.end(), kind)
    blocked = [(m.start(), m.end()) for m in re.finditer(r"(?:Modell|model|modèle) [„\"'«“‘ ]*[^\W\d_]+|https?://\S+|www\.\S+", text)]
    words = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    i = 0
    while i < len(words):
        a, b, w = words[i]
        low = w.lower()
        is_g, is_f = low in given, low in family or any(p in family for p in low.split("-") if len(p) >= 5)
        capital = w[0].isupper()
        if not (is_g or is_f) or (not capital and not (is_f or (i + 1 < len(words) and words[i + 1][2].lower() in family))) or any(x <= a < y for x, y in blocked):
            i += 1
            continue
        if is_g and not is_f and text[max(0, a - 1) : a] in "„'“\"‘«" and text[b : b + 1] in "“'\"’»”":
            i += 1
            continue
        start, end, j = a, b, i
        if is_f and i and re.fullmatch(r"[A-ZÄÖÜ](?:\.-?[A-Z])?", words[i - 1][2]) and re.fullmatch(r"\.? ", text[words[i - 1][1] : a]):
            start = words[i - 1][0]
            if i > 1 and len(words[i - 2][2]) == 1 and re.fullmatch(r"\.[- ]?", text[words[i - 2][1] : start]):
                start = words[i - 2][0]
        while j + 1 < len(words):
            x, y, v = words[j + 1]
            gap = text[end:x]
            known = v.lower() in given or v.lower() in family or any(p in family for p in v.lower().split("-") if len(p) >= 5)
            if re.fullmatch(r"[ ]{1,2}|, ?|\r?\n(?:[>| ]|[A-Z]{2}>)*", gap) and known and (v[0].isupper() == w[0].isupper() or is_f):
                if "," in gap and not (is_f and v.lower() in given):
                    break
                if "\n" in gap and not (is_g and v.lower() in family):
                    break
                if is_g and not is_f and v.lower() in given and v.lower() not in family and low not in family and " " in gap and j + 2 < len(words) and words[j + 2][2].lower() in family:
                    pass
                end, j = y, j + 1
            elif len(v) == 1 and v.isupper() and re.fullmatch(r",? ", gap) and text[y : y + 1] == ".":
                nxt = words[j + 2] if j + 2 < len(words) else None
                if nxt and nxt[2].lower() in family and text[y : nxt[0]] == ". ":
                    end, j = nxt[1], j + 2
                elif is_f or is_g:
                    end, j = y + 1, j + 1
                    break
                else:
                    break
            else:
                break
        add(start, end, "name")
        i = j + 1
    return sorted(taken)


def tags_of(text: str, found: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for a, b, kind in found:
        k = M.KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def window_tags(parts: list[tuple[int, int]], size: int, tags: np.ndarray) -> np.ndarray:
    """The tags of a window of ``windows``, whose parts are (place in the window, place in the text)."""
    out = np.zeros(size, np.int64)
    ends = [w - 1 for w, _ in parts[1:]] + [size]
    for (w, t), end in zip(parts, ends):
        out[w:end] = tags[t : t + end - w]
    for w, _ in parts[1:]:  # a line end inside of a span belongs to it
        if out[w] and out[w] % 2 == 0:
            out[w - 1] = out[w]
    if len(out) and out[0] and out[0] % 2 == 0:
        out[0] -= 1
    return out


def replaced(w: str, t: np.ndarray, rng: random.Random) -> tuple[str, np.ndarray]:
    """The window with generated names, numbers and addresses in the place of its own."""
    text, tags, at = [], [], 0
    for a, b, kind in M.spans(t):
        text.append(w[at:a])
        tags.append(t[at:a])
        old = w[a:b]
        new = old if "\n" in old or rng.random() < 0.2 else pii_forms.like(kind, old, rng)
        text.append(new)
        tags.append(tags_of(new, [(0, len(new), kind)]))
        at = b
    return "".join(text) + w[at:], np.concatenate([*tags, t[at:]])


def generated(n: int, rng: random.Random, held: bool) -> list[tuple[str, np.ndarray]]:
    out = []
    for _ in range(n):
        text, spans = pii_forms.sentence(rng, held)
        tags = tags_of(text, spans)
        out += [(w, window_tags(parts, len(w), tags)) for w, parts in windows(text)]
    return out


def samples(tables: list[str], bound: int, seed: int = 3) -> list[tuple[str, np.ndarray]]:
    given, family = people(tables)
    texts = []
    for d in tables:
        texts += pd.read_parquet(f"{d}/messages.parquet", columns=["body"])["body"].dropna().tolist()
        texts += pd.read_parquet(f"{d}/attachments.parquet", columns=["text"])["text"].dropna().tolist() * 2
    rng = random.Random(seed)
    rng.shuffle(texts)
    seen, rich, plain = set(), [], []
    for text in texts:
        if len(rich) >= bound * 3 // 4 and len(plain) >= bound // 4:
            break
        tags = tags_of(text, label(text, given, family))
        for w, parts in windows(text):
            shape = re.sub(r"\d", "9", w)
            if shape in seen:
                continue
            seen.add(shape)
            t = window_tags(parts, len(w), tags)
            if not t.any():
                plain.append((w, t))
            else:
                rich.append((w, t))
    rng.shuffle(rich)
    rng.shuffle(plain)
    out = rich[: bound * 3 // 4] + plain[: bound // 4]
    rng.shuffle(out)
    return out


_DATA: list[tuple[str, np.ndarray]] = []


def _gradient(task: tuple[dict[str, np.ndarray], list[int], int]) -> tuple[float, int, dict[str, np.ndarray]]:
    weights, rows, seed = task
    rng = random.Random(seed)
    some = [_DATA[i] for i in rows]
    some = [replaced(w, t, rng) if rng.random() < 0.5 and t.any() else (w, t) for w, t in some] + generated(GENERATED, rng, False)
    lengths = np.array([len(w) for w, _ in some])
    ids, tags = np.zeros((len(some), lengths.max()), np.int16), np.zeros((len(some), lengths.max()), np.int64)
    for r, (w, t) in enumerate(some):
        ids[r, : lengths[r]], tags[r, : lengths[r]] = M.encode(w), t
    loss, grad = M.Tagger(weights).loss(ids, lengths, tags)
    return loss, int(lengths.sum()), grad


def train(data: list[tuple[str, np.ndarray]], minutes: float, test: list[tuple[str, np.ndarray]], batch: int = 32, workers: int = 8, rate: float = 0.008, hidden: int = 32) -> M.Tagger:
    """Adam over batches of windows of like length; each step averages the gradients of ``workers`` processes."""
    _DATA[:] = data
    tagger = M.Tagger.fresh(hidden)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    s = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    rng, began, step, epoch = random.Random(1), time.time(), 0, 0
    done = lambda: (time.time() - began) / 60 / minutes
    with multiprocessing.get_context("fork").Pool(workers) as pool:
        while done() < 1:
            order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + rng.random() * 12)
            chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
            groups = [chunks[i : i + workers] for i in range(0, len(chunks), workers)]
            rng.shuffle(groups)
            total = 0.0
            for group in groups:
                got = pool.map(_gradient, [(tagger.w, rows, 8 * step + i) for i, rows in enumerate(group)], 1)
                weight = sum(n for _, n, _ in got)
                grad = {k: sum(g[k] * (n / weight) for _, n, g in got) for k in tagger.w}
                total += sum(loss * n for loss, n, _ in got) / weight
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                scale = min(1.0, 0.25 / (norm + 1e-9))
                lr = rate * max(0.01, 1 - done()) * min(1.0, step / 100)
                for k, g in grad.items():
                    g = g * scale
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.002 * (g * g - s[k])
                    tagger.w[k] = (tagger.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
                if done() >= 1:
                    break
            epoch += 1
            if epoch % 4 == 0 or done() >= 1:
                print(f"epoch {epoch}, {(time.time() - began) / 60:.1f} min: loss {total / len(groups):.5f}; rows held out: {score(M.Tagger(tagger.w), test)}", flush=True)
    return tagger


def score(tagger: M.Tagger, test: list[tuple[str, np.ndarray]]) -> str:
    got = tagger.decode([w for w, _ in test])
    out = []
    for kind in M.KINDS:
        hit = found = true = 0
        for (_, t), g in zip(test, got):
            want = {x for x in M.spans(t) if x[2] == kind}
            have = {x for x in g if x[2] == kind}
            hit, found, true = hit + len(want & have), found + len(have), true + len(want)
        out.append(f"{kind} P {hit / max(1, found):.3f} R {hit / max(1, true):.3f}")
    return ", ".join(out)


def main(argv: list[str]) -> None:
    minutes = float(argv[0])
    data = samples(argv[1:], SAMPLE_WINDOWS)
    test, data = data[:1500], data[1500:]
    print(len(data), "windows,", sum(len(w) for w, _ in data), "characters", flush=True)
    weights = {k: v.astype(np.float16) for k, v in train(data, minutes, test).w.items()}
    np.savez_compressed(WEIGHTS, **weights)
    tagger.cache_clear()
    print("names and forms held out:", held_out(), flush=True)


def held_out(n: int = 3000, seed: int = 77) -> dict[str, tuple[float, float]]:
    """Precision and recall of the whole operator by kind, on sentences, names and forms that are never trained on.

    A span counts as found if one of its kind begins at its beginning.
    """
    rng = random.Random(seed)
    cases = [pii_forms.sentence(rng, True) for _ in range(n)]
    got = find([text for text, _ in cases])
    out = {}
    for kind in M.KINDS:
        want = {(i, a) for i, (_, spans) in enumerate(cases) for a, _, k in spans if k == kind}
        have = {(i, a) for i, f in enumerate(got) for a, _, k in f if k == kind}
        out[kind] = (round(len(want & have) / max(1, len(have)), 3), round(len(want & have) / max(1, len(want)), 3))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
