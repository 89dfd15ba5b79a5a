"""Personal data by weak supervision.

Labelers look at candidate spans and vote for (1), against (-1) or not at all
(0): the strict pattern, checksums, ranges and entropy, gazetteers, the words in
front and the span's shape.  Candidates are base spans, near misses of their
patterns, secrets (keys and tokens), street addresses and names of people.  Votes are counted by (kind, votes, features), a table
whose size doesn't depend on the data.  Expectation-maximisation estimates how
far each labeler can be trusted; the posteriors train a span classifier on the
features alone, which then decides on the spans that the base patterns don't
already hold.  Base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first four have base spans; spans of the others are only ever added.
KINDS = ("email", "ip", "card", "phone", "secret", "place", "name")
N_BASE = 4
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape")
#: Seven bits of any span and three of its kind.
N_FEATURES = 10

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
_VEIL = re.compile(r"[(\[]at[)\]]", re.I)
_VEILED_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
_LOCAL_PHONE = re.compile(r"(?<![\w+.()-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![\w-])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_ASSIGNED = re.compile(r"([\w-]{1,40})[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?$")
_BEARER = re.compile(r"(?i)bearer[ \t]{1,3}$")
_PLACES = (
    re.compile(r"[0-9]{1,5}[a-z]?,? (?:[A-Z][\w'-]{1,30} ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Drive|Square)\b"),
    re.compile(r"[0-9]{1,5},? (?:rue|avenue|boulevard|place|chemin|quai) (?:(?:de|du|des|la|le) |l'|d')*[A-Z][\w'-]{1,30}"),
    re.compile(r"[CcAaPp](?:(?<=[Cc])alle|(?<=[Aa])venida|(?<=[Pp])(?:laza|aseo)) (?:(?:de|del|la|el|los|las) )*[A-Z][\w'-]{1,30}(?: [A-Z][\w'-]{1,30})?,? [0-9]{1,5}\b"),
)
_STREET_END = re.compile(r"(?:straße|strasse|allee|platz|gasse) [0-9]{1,5}[a-z]?\b")
_WRITTEN = re.compile(r"[A-Z\u00C0-\u00DE][\w'-]{1,30}")
_SURNAME = re.compile(r"(?: [A-Z]\.)?(?: (?:van|von|de|del|la|le|der|den))* [A-Z\u00C0-\u00DE][\w'-]{1,30}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Gazetteers and cue words, fixed values.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us ch at it nl be ca au jp cn br mx ru pl se no dk fi pt".split())
CUES = {
    "email": frozenset("mail email e-mail contact write mailto courriel correo kontakt schreiben escribir".split()),
    "ip": frozenset("ip host server address addr from adresse login node peer dirección".split()),
    "card": frozenset("card visa mastercard credit debit payment pay carte tarjeta karte kreditkarte".split()),
    "phone": frozenset("phone tel call mobile fax telephone whatsapp téléphone teléfono telefon handy llamar".split()),
    "secret": frozenset("token key secret password passwd pwd apikey credential credentials bearer authorization passwort kennwort clave contraseña jeton".split()),
    "place": frozenset("address live lives living at adresse wohnt dirección vive habite home".split()),
    "name": frozenset("name named dear regards sincerely author contact signed heißt llama appelle nom nombre".split()),
}
AGAINST = frozenset("isbn issn version v order invoice no nr total sum price id section page".split())
SECRET_AGAINST = frozenset("sha sha1 sha256 md5 hash commit digest checksum etag revision integrity blob uuid guid id src href url".split())
SECRET_PARTS = frozenset("token key secret password passwd pwd apikey credential auth authorization passwort clave".split())
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Madame Monsieur Señor Señora".split())
GIVEN_NAMES = frozenset(
    "Alice Andrea Andreas Anna Antonio Barbara Bernard Carlos Carmen Charles Christine David Elena Elizabeth Emily Emma François "
    "George Hans Hélène Isabel James Javier Jean Jennifer Johann John José Juan Julia Karl Katharina Laura Linda Lucía Luis Manuel "
    "Marie María Martin Mary Michael Miguel Nicole Patricia Paul Peter Philippe Pierre Richard Robert Sabine Sarah Sophie Stefan "
    "Susan Thomas Ursula William Wolfgang".split()
)
NOT_SURNAMES = frozenset("Street Road Avenue University Institute Company Inc Ltd GmbH Hospital College School Airport Bridge Square".split())
_CAPITAL = re.compile(r"[A-Z\u00C0-\u00DE][a-z\u00DF-\u00FF]+\.?(?= )")
_PEOPLE = GIVEN_NAMES | TITLES | {t + "." for t in TITLES}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the mail pattern, found from each @ so that long words cost no more than their length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, m.end()))
        at = text.find("@", done)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _assigned_to(text: str, start: int) -> str | None:
    """The name that the run from ``start`` on is assigned to, lower-cased; '' if the name is none."""
    before = text[max(0, start - 60) : start]
    if _BEARER.search(before):
        return "bearer"
    m = _ASSIGNED.search(before)
    return m and m.group(1).lower()


def _name_parts(name: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+|(?<=api)(?=key)", name))


def _people(text: str) -> list[tuple[int, int]]:
    """Titles or given names with what is written like a surname after them, leftmost first."""
    out, done = [], 0
    for m in _CAPITAL.finditer(text):
        if m.group() not in _PEOPLE:
            continue
        a, b = m.span()
        if a < done or (a and (text[a - 1].isalnum() or text[a - 1] in "'-_")):
            continue
        if m.group().rstrip(".") in TITLES:
            start = b + 1
            given = _WRITTEN.match(text, start)
            if not given:
                continue
            more = _SURNAME.match(text, given.end())
            a, b = start, (more or given).end()
        else:
            more = _SURNAME.match(text, b)
            if not more:
                continue
            b = more.end()
        out.append((a, b))
        done = b
    return out


def _streets(text: str) -> list[tuple[int, int]]:
    out = [m.span() for p in _PLACES for m in p.finditer(text)]
    for m in _STREET_END.finditer(text):
        a = m.start()
        while a > max(0, m.start() - 40) and (text[a - 1].isalpha() or text[a - 1] == "-"):
            a -= 1
        if a < m.start() and text[a].isupper():
            out.append((a, m.end()))
    return sorted(out)


def spans_of(text: str) -> tuple[list[tuple], list[tuple]]:
    """(base spans, other candidates), each (kind number, start, end)."""
    base, rest = [], []
    if not _MARKED.search(text):
        return base, [(6, *s) for s in _people(text)]
    base += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))
        (base if ok else rest).append((1, *m.span()))
    for m in _CHAIN.finditer(text):
        n = len(_digits(m.group()))
        if 16 <= n <= 19 and luhn(_digits(m.group())):
            base.append((2, *m.span()))
        elif 13 <= n <= 19:
            rest.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        (base if 8 <= len(_digits(m.group())) <= 15 else rest).append((3, *m.span()))
    if _VEIL.search(text):
        rest += [(0, *m.span()) for m in _VEILED_MAIL.finditer(text)]
    rest += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    for m in _RUN.finditer(text):
        s = m.group()
        if any("0" <= c <= "9" for c in s) and not s.isdigit() and len(set(s)) > 7:
            rest.append((4, *m.span()))
    rest += [(5, *s) for s in _streets(text)]
    rest += [(6, *s) for s in _people(text)]
    held = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in held]
    reach = list(accumulate((b for _, b in held), max))  # the furthest end of all spans up to one

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or reach[i - 1] <= a

    return base, [c for c in rest if free(c[1], c[2])]


def votes_and_features(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[tuple[int, ...], int]:
    """The labelers' votes and the packed feature bits of one span."""
    span, digits = text[start:end], _digits(text[start:end])
    before = re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-4:]
    cue, anti = any(w in CUES[KINDS[kind]] for w in before), any(w in AGAINST for w in before[-2:])
    tail = re.split(r"[^A-Za-z]+", span)[-1].lower()
    pattern, known_vote, own = (1 if strict else 0), None, (False, False, False)
    if kind == 0:
        checksum, known, odd = 0, tail in TOP_DOMAINS, span.count(".") == 0
        own = ("@" not in span, bool(digits), " " in span)
    elif kind == 1:
        parts = span.split(".")
        good = all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in parts)
        checksum, known, odd = (1 if good else -1), good and int(parts[0]) not in (0, 127, 255), any(len(p) > 1 and p[0] == "0" for p in parts)
        own = (span.startswith(("10.", "192.168.", "172.")), text[end : end + 1] in (":", "/"), len(digits) < 6)
    elif kind == 2:
        good = luhn(digits)
        checksum, known, odd = (1 if good and len(digits) >= 16 else -1), digits[0] in "3456", len(set(digits)) < 4
        own = (good, len(digits) == 16, re.fullmatch(r"[0-9]{4}(?:[ -][0-9]{4}){3}", span) is not None)
    elif kind == 3:
        checksum, known, odd = (1 if 8 <= len(digits) <= 15 else -1), span[0] == "+" or digits[0] not in "01", len(set(digits)) < 3
        own = (span[0] == "+", "(" in span, len(digits) == 10)
    elif kind == 4:
        name = _assigned_to(text, start)
        names = _name_parts(name) if name else set()
        anti = anti or bool(names & SECRET_AGAINST)
        known, wordy = bool(names & (SECRET_PARTS | {"bearer"})), re.search(r"[A-Za-z]{12}|/", span) is not None
        pattern, known_vote = (1 if known and not anti else -1 if anti else 0), 1 if known else -1
        cue = cue or known
        checksum, odd = (1 if _entropy(span.lower()) >= 3 else -1), wordy
        own = (name is not None, re.fullmatch("[0-9A-Fa-f]+", span) is not None, len(span) >= 32)
    elif kind == 5:
        checksum, known, odd = 0, True, len(digits) > 4
        pattern, own = 1, (span[0].isdigit(), "," in span, len(span.split()) > 3)
    else:
        words, title = span.split(), re.search(r"(\w+)\.? $", text[max(0, start - 12) : start])
        titled = title is not None and title.group(1) in TITLES
        known, odd = words[0] in GIVEN_NAMES, words[-1] in NOT_SURNAMES or text[end : end + 1] == "'"
        checksum, pattern, known_vote = 0, 1 if titled else 0, 1 if known else 0 if titled else -1
        own = (titled, len(words) > 2, len(words) == 1)
    told = -1 if kind == 4 and anti else 1 if cue else -1 if anti else 0
    votes = (pattern, checksum, (1 if known else 0) if known_vote is None else known_vote, told, -1 if odd else 1)
    after, prior = text[end : end + 1], text[start - 1 : start]
    bits = (strict, cue, anti, not prior.isalnum(), not after.isalnum(), known and not odd, checksum >= 0, *own)
    return votes, sum(1 << i for i, b in enumerate(bits) if b)


def vote_table(docs: DataFrame) -> DataFrame:
    """Counts by (kind, votes, features); at most 7 * 3^5 * 2^10 rows whatever the data, a few hundred in practice."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    for strict, found in zip((True, False), spans_of(text), strict=True):
                        for kind, a, b in found:
                            votes, bits = votes_and_features(text, kind, a, b, strict)
                            count[kind, sum((v + 1) * 3**i for i, v in enumerate(votes)), bits] += 1
        cols = list(zip(*((*k, n) for k, n in count.items()), strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["kind", "votes", "bits", "n"])

    found = docs.select("text").mapInArrow(run, "kind long, votes long, bits long, n long")
    return found.groupBy("kind", "votes", "bits").agg(F.sum("n").alias("n"))


def fit(rows: list[tuple[int, int, int, int]], rounds: int = 50, ridge: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(labelers' P(vote | truth) by kind, classifier weights by kind) from vote counts."""
    trust = np.full((len(KINDS), 2, len(LABELERS), 3), 1 / 3)
    weights = np.zeros((len(KINDS), N_FEATURES + 1))
    for kind in range(len(KINDS)):
        own = np.array([r[1:] for r in rows if r[0] == kind], np.int64).reshape(-1, 3)
        if not len(own):
            weights[kind, 0] = -5
            continue
        votes = own[:, 0, None] // 3 ** np.arange(len(LABELERS)) % 3
        n = own[:, 2].astype(float)
        p = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1) + 1.5))  # to begin with, a majority by two
        for _ in range(rounds):
            prior = (p @ n + 1) / (n.sum() + 2)
            odds = np.full(len(n), np.log(prior / (1 - prior)))
            for j in range(len(LABELERS)):
                one = np.eye(3)[votes[:, j]]
                # pseudo-counts keep a labeler from being turned round by few spans
                for truth, w, lean in ((0, 1 - p, (4, 2, 1)), (1, p, (1, 2, 4))):
                    c = (w * n) @ one + np.array(lean)
                    trust[kind, truth, j] = c / c.sum()
                odds += np.log(trust[kind, 1, j][votes[:, j]] / trust[kind, 0, j][votes[:, j]])
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        x = np.concatenate([np.ones((len(own), 1)), own[:, 1, None] >> np.arange(N_FEATURES) & 1], 1)
        w = np.zeros(N_FEATURES + 1)
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
            w = w + np.linalg.solve(h, x.T @ (n * (p - q)) - ridge * w)
        weights[kind] = w
    return trust, weights


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """One row per document: ids, base counts, digest of the base spans, all spans, number added.

    Null texts count as empty and have no spans; texts have any length; repeated
    rows give equal rows; an empty table gives an empty result; other columns are
    ignored.  Overlapping spans of different kinds are all reported, but added ones
    never overlap a base span.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, weights = fit([tuple(r) for r in vote_table(docs).collect()])  # bounded by its key
    sure = np.array([[1 / (1 + np.exp(-(weights[k, 0] + sum(weights[k, 1 + i] for i in range(N_FEATURES) if bits >> i & 1)))) for bits in range(1 << N_FEATURES)] for k in range(len(KINDS))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def join(spans):
            return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))

        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base, rest = spans_of(text)
                new = [c for c in rest if sure[c[0], votes_and_features(text, *c, False)[1]] >= threshold] if rest else []
                n = Counter(k for k, _, _ in base)  # kinds that are only added have no base spans
                told = join(base)
                for col, v in zip(cols, (*(n[k] for k in range(N_BASE)), hashlib.sha256(told.encode()).hexdigest(), join(base + new) if new else told, len(new)), strict=True):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
