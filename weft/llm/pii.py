"""Personal data in texts: exact patterns, and a linear-chain conditional random field.

The patterns find emails, IPv4 addresses, payment cards and phone numbers. The field
adds what has no fixed form: names of persons and ways of contact that a cue word
announces. Its features are the class of a word (its shape, or its cue list) and the
classes of its neighbours; it is trained on the labelled table below by full-batch
gradient ascent, and decoded line by line with Viterbi, many lines at a time.

Cases: null and empty texts have no spans; texts are read whole, however long; equal
texts get equal spans; an empty table gives no rows; further columns are not read.
Positions are code points, ends exclusive. A field's span that touches a pattern's span
is left out; the patterns' spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import per_batch, small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("person", "contact")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, so that long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """An email's left side is all that may stand there before its @, back to the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            out.append((start, last))
        at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind and then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


# The labelled table: [words|kind] are spans, all else is none.
LABELLED = """
Name: [Carlos Ortega|person]
Name: [Li Wei|person]
name: [Maria Rossi|person] age 34
Nombre: [Lucía Navarro|person], edad 41
Nom: [Hélène Dubois|person]
Vorname: [Jonas|person]
Surname: [Whitfield|person]
Mr. [Thomas Brown|person] was there
Mr [Peter Jones|person] said that he agreed
Mr [Okafor|person] signed the lease
Mrs. [Jane Doe|person] wrote to us
Mrs [Abbott|person] has moved
Miss [Emily Hart|person] teaches here
Ms. [Helen Clark|person] has left
Ms [Ito|person] paid the bill
Dr. [Emil Novak|person] will see you
Dr [Sara Lind|person] came late
Prof. [A. Banerjee|person] gave a talk
The letter came from Mr. [Oliver Stone Grant|person] on Monday
We met Dr. [Ruth Adeyemi|person], who agreed.
Ask Mrs. [Nora Quinn|person] or Mr. [Paul Reyes|person] for the key
Herr [Karl Schmidt|person] ist da
Frau [Julia Weber|person] kommt heute
Gestern rief Frau [Vogel|person] an
Monsieur [Jean Martin|person] est ici
Madame [Claire Petit|person] arrive
Nous avons vu Madame [Roux|person] hier
Señor [Luis Gomez|person] vive en la ciudad
Señora [Carmen Ruiz|person] no vive en la casa
El Señor [Vega|person] ha pagado
Dear [Anna|person], thank you for the book
Liebe [Sabine Koch|person], vielen Dank
Querido [Pablo|person], gracias por todo
contact Mr. [Alan Poe|person] at [555-0134|contact] please
call me at [555-0134|contact]
call [555 0199|contact] after six
call me on [(030) 901820|contact] today
write or call [0161 496 0123|contact] before noon
phone: [030 901820|contact]
Phone: [(555) 123-4567|contact]
phone [555-0172|contact]
tel: [020 7946 0018|contact]
Tel. [01 23 45 67 89|contact]
Tel [089 1234567|contact]
mobile: [0171 2345678|contact]
mobile [07700 900123|contact], evenings only
fax: [555-123-4567|contact]
Telephone: [0800 555 111|contact]
Teléfono: [912 345 678|contact]
Handy: [0160 9876543|contact]
reach us on [01632 960 456|contact] at any time
The house stood by the river and the wind was cold
In the morning they went to the market and bought bread
Of the three only two came back before the night
Paris and London are large. Rome is old.
On Monday the Council of Europe met in Strasbourg
The President of the United States spoke at Camp David
She read War and Peace and then Moby Dick
He moved from New York to San Francisco in June
Microsoft Windows and Apple Music are products
It was 1999 and there were 24 of them in 3 rooms
In 2015 and 2016 the sales rose by 40 to 1200
He paid 1200 for it on the 5 of May
The total is 555 and the rest is 123
Order 4471 has 12 items and weighs 300 grams
Version 2 has 17 parts and 400 pages
See chapter 12 for more on that
The train leaves at 1030 from platform 4
Meet at 1800 on 24 June at the station
It opened on 12 May 1987 with 4000 seats
Look at 555 and on 12 of them
The score was 21-17 at half time and 44-30 on Sunday
pages 100-150 and lines 2000-2500 of the book
All rights reserved.
Die alte Stadt lag am Fluss und der Wind war kalt
Der Mann und die Frau gingen zum Markt
Die Frau Und Das Meer Ist Ein Film
Im Jahr 1999 waren es 24
Am Montag fuhr der Zug nach Berlin und München
Les enfants jouent dans le jardin et la rue
La ville de Lyon est grande
Le chat dort sur la table
El perro corre por la calle y la plaza
La casa es grande y la mesa es de madera
En Madrid y Sevilla hace calor
a list | of | words | with | bars
name of the river is not known
the name was on the door
The Name Of The Rose is a novel
they call the place a harbour
They call it The Big House
write to me when you can
contact us at the office or by mail
the phone was on the table and the mail was late
he is at home at noon at last
a dot on the map and a dot on the wall
at the end of the day the tel was gone
call the shop and write a note
my dear old friend came at noon
Dear all, the office is closed
oh dear The River Is High
THE HOUSE AND THE RIVER. ALL OF IT IN THE NIGHT
The. And. Of. In. To. Then. Here.
x = y and http://example.org/a/b the and
en-route the in-between and so-called well-known
camelCase and someName in oneFile
1,200 2.5 and 3.14 or 10:30 and 12/05
### *** --- | the end | of it
10 20 30 40 50
2001 2002 2003 2004
100000 200000 300000
""".strip().split("\n")

# Cue words by list, compared in lower case without signs at their ends.
CUES = {
    "title": "mr mrs ms miss dr prof herr frau monsieur madame señor señora",
    "name": "name nombre nom vorname surname",
    "dear": "dear liebe lieber querido querida cher chère",
    "call": "call contact write phone tel telephone mobile fax mail email ring teléfono handy",
    "me": "me us",
    "at": "at",
    "on": "on to",
}
_CUE_OF = {word: cue for cue, words in CUES.items() for word in words.split()}
_SIGNS = ".,;:!?"


def word_class(word: str) -> str:
    """A cue list's name, or the word's shape; with what sign it ends."""
    core = word.rstrip(_SIGNS)
    end = ":" if word.endswith(":") else "." if len(core) < len(word) else ""
    if (cue := _CUE_OF.get(core.lower())) is not None:
        return cue + (":" if end == ":" else "")
    if not core:
        return "sign"
    if core.isalpha():
        shape = "x" if core.islower() else "X" if core.isupper() else "Xx" if core[0].isupper() and core[1:].islower() else "xX"
    elif core.strip("()-/").isdigit() or core.replace("-", "").strip("()").isdigit():
        shape = "d" if len(core) <= 2 else "dd" if len(core) <= 4 and core.isdigit() else "dd+"
    elif any(c.isdigit() for c in core):
        shape = "xd"
    else:
        shape = "?"
    return shape + end


#: Every class there can be, in a fixed order; the last stands for "beyond the line's end".
CLASSES = [*(c + e for c in CUES for e in ("", ":")), "sign", *(s + e for s in ("x", "X", "Xx", "xX", "d", "dd", "dd+", "xd", "?") for e in ("", ".", ":")), "none"]
_NUMBER = {c: k for k, c in enumerate(CLASSES)}
LABELS = ["O", *(f"{b}-{kind}" for kind in ADDED for b in "BI")]


def _labelled() -> list[tuple[list[int], list[int]]]:
    out = []
    for line in LABELLED:
        words, tags = [], []
        for part in re.findall(r"\[[^|\]]*\|[a-z]+\]|\S+", line):
            if part[0] == "[" and "|" in part:
                inner, kind = part[1:-1].split("|")
                got = inner.split()
                tags += [f"B-{kind}", *[f"I-{kind}"] * (len(got) - 1)]
            else:
                got = [part]
                tags.append("O")
            words += got
        out.append(([_NUMBER[word_class(w)] for w in words], [LABELS.index(t) for t in tags]))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    """Weights of a label at a word: own class, the class before and after it; and of a label after a label."""

    def __init__(self) -> None:
        c, s = len(CLASSES), len(LABELS)
        self.here, self.before, self.after = (np.zeros((c, s)) for _ in range(3))
        self.step = np.zeros((s, s))
        for k, label in enumerate(LABELS):  # a span's inside follows only its own kind
            if label[0] == "I":
                self.step[[j for j, other in enumerate(LABELS) if other[2:] != label[2:]], k] = -1e4

    def scores(self, classes: np.ndarray) -> np.ndarray:
        none = len(CLASSES) - 1
        left = np.concatenate([np.full((*classes.shape[:-1], 1), none), classes[..., :-1]], axis=-1)
        right = np.concatenate([classes[..., 1:], np.full((*classes.shape[:-1], 1), none)], axis=-1)
        return self.here[classes] + self.before[left] + self.after[right]

    def light(self) -> Field:
        """The same in single precision, for decoding."""
        out = Field()
        out.here, out.before, out.after, out.step = (w.astype(np.float32) for w in (self.here, self.before, self.after, self.step))
        return out

    def fit(self, rows: list[tuple[list[int], list[int]]], rounds: int = 150, rate: float = 0.4, decay: float = 0.01) -> Field:
        """Gradient ascent on the mean log-likelihood less a quadratic penalty, with steps scaled by past gradients."""
        fixed = self.step < -1e3
        weights = [self.here, self.before, self.after, self.step]
        past = [np.full(w.shape, 1e-8) for w in weights]
        none = len(CLASSES) - 1
        inside = np.array([label[0] == "I" for label in LABELS])
        for _ in range(rounds):
            grads = [np.zeros(w.shape) for w in weights]
            for classes, tags in rows:
                x, y = np.array(classes), np.array(tags)
                e = self.scores(x)
                e[0, inside] = -1e4
                n = len(x)
                fore, back = np.zeros_like(e), np.zeros_like(e)
                fore[0] = e[0]
                for t in range(1, n):
                    fore[t] = e[t] + _logsum(fore[t - 1][:, None] + self.step, 0)
                for t in range(n - 2, -1, -1):
                    back[t] = _logsum(self.step + (e[t + 1] + back[t + 1])[None, :], 1)
                z = _logsum(fore[-1], 0)
                miss = -np.exp(fore + back - z)
                miss[np.arange(n), y] += 1
                left, right = np.append(none, x[:-1]), np.append(x[1:], none)
                for g, c in zip(grads, (x, left, right)):
                    np.add.at(g, c, miss)
                for t in range(1, n):
                    grads[3] -= np.exp(fore[t - 1][:, None] + self.step + (e[t] + back[t])[None, :] - z)
                    grads[3][y[t - 1], y[t]] += 1
            grads[3][fixed] = 0
            for w, g, p in zip(weights, grads, past):
                g = g - decay * np.where(np.abs(w) < 1e3, w, 0)
                p += g * g
                w += rate * g / np.sqrt(p)
        return self

    def viterbi(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of lines padded to one length, rows by words; beyond a line's end they mean nothing."""
        e = self.scores(classes)
        e[:, 0, [k for k, label in enumerate(LABELS) if label[0] == "I"]] = -1e4
        n, most, s = e.shape
        step = self.step.T[None]
        came = np.zeros((most, n, s), dtype=np.int8)
        best = e[:, 0].copy()
        for t in range(1, most):
            ways = best[:, None, :] + step
            came[t] = ways.argmax(axis=2)
            new = e[:, t] + np.take_along_axis(ways, came[t][:, :, None].astype(np.intp), 2)[:, :, 0]
            goes = (lengths > t)[:, None]
            best = np.where(goes, new, best)
        out = np.zeros((n, most), dtype=np.int8)
        now, rows = best.argmax(axis=1), np.arange(n)
        for t in range(most - 1, -1, -1):
            out[:, t] = now
            if t:
                now = np.where(lengths > t, came[t][rows, now], now)
        return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field().fit(_labelled()).light()


class _Classes(dict):
    def __missing__(self, word: str) -> int:
        number = _NUMBER[word_class(word)]
        if len(self) < 300_000:
            self[word] = number
        return number


_classes = _Classes()

#: Words of padded lines that are decoded at once.
BLOCK = 200_000


def field_labels(field: Field, lines: list[np.ndarray]) -> list[np.ndarray]:
    """Labels of each line's words; lines of like length are decoded together."""
    order = sorted(range(len(lines)), key=lambda k: len(lines[k]))
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(lines)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(lines[order[to]]) * (to + 1 - at) <= BLOCK and len(lines[order[to]]) <= 1.25 * len(lines[order[at]]) + 4:
            to += 1
        some = order[at:to]
        lengths = np.array([len(lines[k]) for k in some])
        if lengths[-1]:
            padded = np.full((len(some), int(lengths[-1])), len(CLASSES) - 1, dtype=np.int32)
            for row, k in enumerate(some):
                padded[row, : len(lines[k])] = lines[k]
            got = field.viterbi(padded, lengths)
            for row, k in enumerate(some):
                out[k] = got[row, : len(lines[k])]
        at = to
    return out


def _line_spans(line: str, offset: int, labels: np.ndarray) -> list[tuple[str, int, int]]:
    words = [m.span() for m in re.finditer(r"\S+", line)]
    out: list[list] = []
    for (s, e), k in zip(words, labels.tolist()):
        label = LABELS[k]
        if label[0] == "B" or label[0] == "I" and not out:
            out.append([label[2:], s, e])
        elif label[0] == "I":
            out[-1][2] = e
    return [(kind, offset + s, offset + s + len(line[s:e].rstrip(_SIGNS))) for kind, s, e in out]


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text that touch none of its pattern spans."""
    lines, owners = [], []
    classes = _classes
    for k, text in enumerate(texts):
        offset = 0
        for line in text.split("\n"):
            if line:
                lines.append((line, offset))
                owners.append(k)
            offset += len(line) + 1
    numbers = [np.fromiter(map(classes.__getitem__, line.split()), dtype=np.int32) for line, _ in lines]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k, (line, offset), labels in zip(owners, lines, field_labels(field, numbers)):
        if labels.any():
            for span in _line_spans(line, offset, labels):
                if span[1] < span[2] and not any(s < span[2] and span[1] < e for _, s, e in bases[k]):
                    out[k].append(span)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts by kind, base_sha256, and spans of all kinds as an array of structs."""
    small_batches(docs.sparkSession)
    field = trained()
    kinds = (*BASE, *ADDED)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in kinds), ("base_sha256", pa.string()), ("spans", pa.list_(span))])

    def read(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        bases = [base_spans(t) for t in texts]
        added = added_spans(texts, bases, field)
        every = [b + sorted(a, key=lambda x: (ADDED.index(x[0]), x[1])) for b, a in zip(bases, added)]
        counts = {f"n_{k}": [sum(x[0] == k for x in spans) for spans in every] for k in kinds}
        digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases]
        return {"doc_id": batch.column(0), **counts, "base_sha256": digests, "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in every]}

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(per_batch(read, schema), ddl)


def span_text(column: str = "spans") -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
