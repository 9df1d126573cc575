"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Candidates are what the base patterns match (e-mail, IP, card, phone) and what
looser ones do (addresses spelt out, phones without a plus, identity numbers,
secrets, titled names). Five labelers look at each candidate and vote for or
against it, or abstain: pattern, checksum, gazetteer, words before it, and
whether it stands alone. Candidates are counted by kind, votes and look (some
20,000 combinations at most, whatever the input); expectation-maximisation on
these counts estimates how reliable each labeler is, and its posteriors train a
logistic span classifier on kind, votes and what the span looks like: its length,
and how much of it is digits. Base matches that pass their own
test always stay; of the others those stay that the classifier accepts. No
label is needed.

Scale: one pass over the texts, in which rows are independent; candidates are
stored, counted with map-side combine, and filtered by a short list of accepted
combinations. Texts are searched whole, in time linear in their length:
addresses are looked for around each @, quads where a run of digits begins.

Null text: as empty, no spans. Spans of one kind do not overlap, and looser
candidates give way to base matches. Repeated rows are all returned. No
candidates or an empty table: nothing is estimated. Extra columns are carried
in ``_row``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import boxed, text_or_empty
from tallybook.session import stored

KINDS = ("email", "ip", "card", "phone", "id", "secret", "name")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "alone")
CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,look:int>>"
# Looks of a span: lengths below each of these and beyond, each with few, some or mostly digits.
LENGTHS = (10, 18, 32)
DIGITS = (0.1, 0.6)
LOOKS = (len(LENGTHS) + 1) * (len(DIGITS) + 1)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Matches begin where digits begin, and no part gives digits back: linear on runs of any length.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,64}){1,4}", re.I),
    "phone": re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"[A-Za-z0-9_+/=-]{24,}"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. ?[A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?"),
}
# What every match of the loose patterns holds, the latter in small letters.
_TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.")
_SPELT = ("(at)", "[at]", " at ")
# Short lists of fixed values that a gazetteer labeler knows.
_TOP_LEVEL = {"com", "org", "net", "edu", "gov", "io", "info", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at"}
_CALLING = ("1", "31", "33", "34", "39", "41", "43", "44", "46", "49", "55", "61", "81", "86", "91")
_FIRST_NAMES = {
    "james", "mary", "john", "anna", "maria", "peter", "paul", "michael", "thomas", "sarah", "laura", "julia",
    "david", "daniel", "emma", "marie", "jean", "pierre", "carlos", "jose", "luis", "hans", "karl", "sofia",
}
_BEFORE = {
    "email": ("mail", "contact", "write", "reach", "to"),
    "ip": ("ip", "host", "server", "address", "from", "with"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "id": ("ssn", "social", "identity", "id"),
    "secret": ("token", "key", "secret", "password", "bearer", "auth"),
    "name": ("name", "by", "author", "dear", "contact"),
}
_AGAINST = ("version", "isbn", "issn", "order", "invoice", "section", "page", "doi", "http", "sha", "md5")
_WORDS_BEFORE = re.compile(r"[a-z]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order; those that fail their test are gone."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        # Leading zeros go first: Python converts no more than 4,300 digits.
        if all(len(d := x.lstrip("0")) <= 3 and int(d or "0") <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _loose_spans(text: str, taken: Sequence[tuple[int, int, int]], has_digit: bool) -> list[tuple[int, int, int]]:
    """Looser candidates that overlap no span in ``taken`` and none before them."""
    wanted = [k for k in ("phone", "id", "secret") if has_digit]
    wanted += ["name"] if any(t in text for t in _TITLES) else []
    low = text.lower()
    wanted += ["email"] if "dot" in low and any(s in low for s in _SPELT) else []
    found = sorted((m.start(), KINDS.index(k), m.end()) for k in wanted for m in _LOOSE[k].finditer(text))
    taken, i, end, kept = sorted(taken), 0, 0, []
    for a, k, b in found:
        while i < len(taken) and taken[i][2] <= a:
            i += 1
        if a < end or (i < len(taken) and taken[i][0] < b):
            continue
        held = text[a:b]
        if KINDS[k] == "secret" and not (any(c.isdigit() for c in held) and any(c.isalpha() for c in held)):
            continue
        end = b
        kept.append((a, k, b))
    return kept


def _sign(good: bool, bad: bool = False) -> int:
    return 1 if good else -1 if bad else 0


def vote(text: str, start: int, kind: int, end: int, base: bool) -> int:
    """The votes of all labelers, one base-3 digit each."""
    held, name = text[start:end], KINDS[kind]
    digits = _digits(held)
    if name == "email":
        top = held.rpartition("." if "." in held else " ")[2].lower()
        check, known = _sign(top.isalpha(), not top.isalpha()), _sign(top in _TOP_LEVEL)
    elif name == "ip":
        check, known = _sign(True), _sign(False, held.startswith(("0.", "10.", "127.", "192.168.")))
    elif name == "card":
        check = _sign(_luhn(digits), True)
        known = _sign(digits[0] in "3456", True)
    elif name == "phone":
        check = _sign(9 <= len(digits) <= 15, True)
        known = _sign(held[0] == "+" and digits.startswith(_CALLING))
    elif name == "id":
        check, known = _sign(not digits.startswith(("000", "666", "9")), True), 0
    elif name == "secret":
        share = [held.count(c) / len(held) for c in set(held)]
        check, known = _sign(-sum(p * math.log2(p) for p in share) > 3, True), 0
    else:
        words = held.replace(".", " ").lower().split()
        check, known = _sign(len(words) > 2), _sign(words[1] in _FIRST_NAMES)
    before = _WORDS_BEFORE.findall(text[max(0, start - 32) : start].lower())[-3:]
    context = _sign(any(w in _BEFORE[name] for w in before), any(w in _AGAINST for w in before))
    joined = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    pattern = _sign(base or (name == "secret" and re.fullmatch(r"[0-9a-f]{32,}|[A-Z0-9]{24,}", held) is not None))
    out = 0
    for v in (pattern, check, known, context, _sign(not joined, joined)):
        out = 3 * out + v + 1
    return out


def look(text: str) -> int:
    """Number of a span's look."""
    share = len(_digits(text)) / len(text)
    return bisect.bisect_right(LENGTHS, len(text)) * (len(DIGITS) + 1) + bisect.bisect_right(DIGITS, share)


def candidates(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, start, end, base, votes, look) of all candidates of a text, in order."""
    has_digit = re.search("[0-9]", text) is not None
    base = base_spans(text) if has_digit or "@" in text else []
    spans = [(*s, True) for s in base] + [(*s, False) for s in _loose_spans(text, base, has_digit)]
    return [(k, a, b, own, vote(text, a, k, b, own), look(text[a:b])) for a, k, b, own in sorted(spans)]


def _signs(votes: np.ndarray) -> np.ndarray:
    """(patterns, labelers) of -1, 0, 1."""
    powers = 3 ** np.arange(len(LABELERS) - 1, -1, -1)
    return votes[:, None] // powers % 3 - 1


def weigh(
    kind: np.ndarray, votes: np.ndarray, count: np.ndarray, rounds: int = 50, trust: tuple[float, float] = (8, 2)
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior that each combination is personal data, and how often each labeler is right, by EM.

    ``trust`` are imagined right and wrong votes, the starting point. Before any vote a candidate is as likely as not.
    """
    signs = _signs(votes)
    accuracy = np.full(len(LABELERS), trust[0] / sum(trust))
    posterior = np.full(len(kind), 0.5)
    for _ in range(rounds):
        posterior = 1 / (1 + np.exp(-(signs * np.log(accuracy / (1 - accuracy))).sum(axis=1)))
        right = np.where(signs > 0, posterior[:, None], np.where(signs < 0, 1 - posterior[:, None], 0))
        accuracy = ((right * count[:, None]).sum(axis=0) + trust[0]) / (
            ((signs != 0) * count[:, None]).sum(axis=0) + sum(trust)
        )
    return posterior, accuracy


def span_features(kind: np.ndarray, votes: np.ndarray, looks: np.ndarray) -> np.ndarray:
    """What the span classifier sees: kind, votes, and length and share of digits by themselves."""
    signs = _signs(votes)
    length, digits = np.divmod(looks, len(DIGITS) + 1)
    return np.hstack(
        [
            np.ones((len(kind), 1)),
            kind[:, None] == np.arange(len(KINDS)),
            signs > 0,
            signs < 0,
            length[:, None] == np.arange(len(LENGTHS) + 1),
            digits[:, None] == np.arange(len(DIGITS) + 1),
        ]
    ).astype(float)


def fit_classifier(x: np.ndarray, count: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Chance of each combination under a logistic model of its features, fitted to the posteriors."""
    share = count / count.sum() * min(count.sum(), 1e4)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (share * (target - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _code(kind, votes, looks):
    """One number for a combination, of arrays or of columns."""
    return (kind * 3 ** len(LABELERS) + votes) * LOOKS + looks


def find(docs: DataFrame, text: str = "text", threshold: float = 0.5, carry: Sequence[str] | None = None) -> DataFrame:
    """``_row`` and ``_spans``: structs (start, kind, end, base), in order; ``kind`` counts in ``KINDS``."""

    @F.pandas_udf(CANDIDATES)
    def looked(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base", "votes", "look")
        return pd.Series([[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in texts], dtype=object)

    rows = stored(docs.select(boxed(docs, carry), looked(text_or_empty(text)).alias("_c")))
    counted = rows.select(F.explode("_c").alias("c")).groupBy("c.kind", "c.votes", "c.look").count().collect()
    accepted: list[int] = []
    if counted:
        kind, votes, looks, count = (np.array([r[n] for r in counted]) for n in ("kind", "votes", "look", "count"))
        posterior, _ = weigh(kind, votes, count)
        chance = fit_classifier(span_features(kind, votes, looks), count.astype(float), posterior)
        accepted = sorted(_code(kind, votes, looks)[chance >= threshold].tolist())
    listed = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<int>")
    kept = F.filter("_c", lambda c: c["base"] | F.array_contains(listed, _code(c["kind"], c["votes"], c["look"])))
    spans = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base")))
    return rows.select("_row", F.sort_array(spans).alias("_spans"))


def count_of(kind: str, spans: str = "_spans") -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def masked(text: str | None, spans) -> str | None:
    """``text`` with each span replaced by its kind in brackets; overlapping spans as one."""
    at, parts = 0, []
    for s in spans if text else ():
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        at = max(at, s["end"])
    return "".join(parts) + text[at:] if parts else text


def without_personal_data(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data masked in ``text``, and its length anew in ``n_chars`` if there is such a column."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([masked(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    own = F.col("_row").getField(text)
    clean = find(docs, text).select("_row", F.when(F.size("_spans") > 0, redact(own, "_spans")).otherwise(own).alias("_clean"))
    row = F.col("_row").withField(f"`{text}`", F.col("_clean"))
    if n_chars in docs.columns:
        old = F.col("_row").getField(n_chars)
        length = F.length("_clean").cast(dict(docs.dtypes)[n_chars])
        row = row.withField(f"`{n_chars}`", F.when(F.col("_clean").eqNullSafe(own), old).otherwise(length))
    return clean.select(row.alias("_row")).select("_row.*")
