"""Personal data in texts: patterns propose spans, checks confirm them, words nearby adjust their scores.

Each kind has a pattern, whose leftmost matches that don't overlap are proposed, a check (parts of an address, Luhn's sum,
the remainder modulo 97, digits counted) and a score to start from. A passed checksum adds to it, words that go with the
kind within ``BEFORE`` characters before the span or ``AFTER`` behind it add too, words of versions and samples take away.

Spans of the base kinds stay whatever their score; spans of the further kinds stay from ``THRESHOLD`` on, unless they
lie within a base span.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import LOWER, UPPER, table

#: Characters looked at before and behind a span, the score from which spans of further kinds stay, and what is added or taken away.
BEFORE, AFTER, THRESHOLD = 40, 20, 0.5
CONFIRMED, NEAR, AGAINST = 0.4, 0.3, 0.4
#: Words that speak against every kind.
UNLIKE = "version|sample|isbn|sku"
#: Lengths of account numbers by country.
IBAN = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def digits_of(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the weighted sum of digits ends in 0, every second one from the right doubled and its own digits added."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number, its first four characters moved behind, letters as 10 to 35, leaves 1 modulo 97."""
    left = 0
    for c in account[4:] + account[:4]:
        left = (left * (10 if c <= "9" else 100) + int(c, 36)) % 97
    return left == 1


def small_parts(address: str) -> bool:
    """Whether all parts are 255 at most, however many zeros they begin with."""
    return all(len(p) < 3 or len(p) == 3 and p <= "255" for p in (q.lstrip("0") for q in address.split(".")))


def account(found: str, left: str, rest: str) -> bool:
    """Whether an account number stands alone and its checksum is right."""
    return not re.match("[A-Za-z0-9]", left) and not re.match("[A-Za-z0-9]", rest) and mod97(found.replace(" ", ""))


def security_number(found: str, left: str, rest: str) -> bool:
    right = found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"
    return right and not re.match("[0-9-]", left) and not re.match("[0-9-]", rest)


def local_number(found: str, left: str, rest: str) -> bool:
    return not re.match("[0-9+(-]", left) and not re.match("[0-9-]", rest)


@dataclass(frozen=True)
class Kind:
    """``check`` takes a match and the characters next to it. ``passed`` are runs in which no match begins where none begins with them."""

    name: str
    pattern: str
    check: Callable[[str, str, str], bool]
    start: float
    words: str
    base: bool = False
    checksum: bool = False
    passed: str = ""


def _own(right: Callable[[str], bool]) -> Callable[[str, str, str], bool]:
    return lambda found, left, rest: right(found)


def account_pattern() -> str:
    """Account numbers of each country in its own length, single spaces among them."""
    names = {n: "|".join(sorted(c for c, m in IBAN.items() if m == n)) for n in sorted(set(IBAN.values()))}
    return "|".join(f"(?:{own})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, own in names.items())


#: In the order in which spans of one start are listed. Runs that are passed over are read once, however long.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _own(bool), 0.8, "mail|email|contact|write", base=True, passed="[A-Za-z0-9._%+-]++"),
    Kind("ip", r"[0-9]++(?:\.[0-9]++){3}", _own(small_parts), 0.5, "ip|host|server|address", base=True, passed="[0-9]++"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])+", _own(lambda found: 12 <= len(d := digits_of(found)) <= 19 and luhn(d)), 0.3, "card|visa|payment|credit", base=True, checksum=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _own(lambda found: 9 <= len(digits_of(found)) <= 15), 0.6, "phone|tel|call|fax|mobile", base=True),
    Kind("iban", account_pattern(), account, 0.3, "iban|account|bank|konto|compte|cuenta", checksum=True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", security_number, 0.3, "ssn|social|security|taxpayer"),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", local_number, 0.3, "phone|tel|call|fax|mobile"),
)
BASE = [k.name for k in KINDS if k.base]
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def _word(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![a-z])(?:{words})(?![a-z])", re.IGNORECASE | re.ASCII)


_PATTERNS = {k.name: (re.compile(f"({k.pattern})|{k.passed}" if k.passed else f"({k.pattern})"), _word(k.words)) for k in KINDS}
_UNLIKE = _word(UNLIKE)


def scored(kind: Kind, text: str, start: int, end: int) -> float:
    """The score of a span that has passed its check."""
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    near = _PATTERNS[kind.name][1]
    score = kind.start + CONFIRMED * kind.checksum
    score += NEAR * bool(near.search(before) or near.search(after))
    score -= AGAINST * bool(_UNLIKE.search(before) or _UNLIKE.search(after))
    return round(min(1.0, max(0.0, score)), 2)


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of a whole text by start, then by kind; characters are code points, ends are exclusive."""
    numbers, out = re.search("[0-9]", text) is not None, []
    if not numbers and "@" not in text:
        return out
    for place, kind in enumerate(KINDS):
        if "@" not in text if kind.name == "email" else not numbers:
            continue
        for m in _PATTERNS[kind.name][0].finditer(text):
            if m[1] is None:
                continue
            start, end = m.span(1)
            if kind.check(m[1], text[max(0, start - 1) : start], text[end : end + 1]):
                out.append((start, place, end, scored(kind, text, start, end)))
    out.sort()
    kept, reach = [], 0  # how far base spans reach that begin here or before; they come first at one start
    for start, place, end, score in out:
        kind = KINDS[place]
        if kind.base:
            reach = max(reach, end)
        elif score < threshold or end <= reach:
            continue
        kept.append((kind.name, start, end, score, kind.base))
    return kept


#: Characters of texts that a task handles at once.
BATCH_CHARS = 1 << 22


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id and spans, an array of (kind, start, end, score, base) by start, then kind.

    A null or empty text has no spans. Texts are read whole, however long, each once or a few times for each kind. Null and repeated identifiers are kept,
    equal rows give equal rows. An empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch["text"], 0
            while at < batch.num_rows:
                found, size = [], 0
                while at + len(found) < batch.num_rows and len(found) < 1024 and size < BATCH_CHARS:
                    text = texts[at + len(found)].as_py() or ""
                    found.append(spans_of(text, threshold))
                    size += len(text)
                flat = [s for own in found for s in own]
                fields = [pa.array([s[k] for s in flat], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()))]
                offsets = [0]
                for own in found:
                    offsets.append(offsets[-1] + len(own))
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["kind", "start", "end", "score", "base"]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(found)), spans], names=["doc_id", "spans"])
                at += len(found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(text: str, threshold: float = THRESHOLD) -> str:
    """The text with each stretch covered by spans replaced by the kind of the first of them, in brackets."""
    out, at, covered = [], 0, -1
    for kind, start, end, _, _ in spans_of(text, threshold):
        if start >= covered:
            out += [text[at:start], f"[{kind.upper()}]"]
        covered = max(covered, end)
        at = covered
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in brackets; all other columns, and null texts, stay as they are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t, threshold))

    return docs.withColumn("text", run(F.col("text").cast("string")))


def listed(spans):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of ``documents``: base spans by kind and digest, and all spans; ``scores`` follow the order of ``spans``."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(spans, s -> s.base AND s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), listed("spans").alias("spans"), scores.alias("scores"))


def _sql_kind(kind: Kind) -> str:
    """Rows of one kind's matches: where they start, found by the lengths of what stands between them."""
    pattern = kind.pattern.replace("++", "+")
    return f"""
  SELECT doc_id, t, '{kind.name}' AS kind, {[k.name for k in KINDS].index(kind.name)} AS place, {kind.start} AS begun, {kind.base} AS base, {kind.checksum} AS checksum,
         '(^|[^a-z])({kind.words})([^a-z]|$)' AS words, found[i] AS f, list_sum(list_transform(parts[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS parts FROM docs), unnest(range(1, len(found) + 1)) AS u(i)"""


OP13_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(map(_sql_kind, KINDS))}
), near AS (
  SELECT *, s + length(f) AS e, substr(t, s, 1) AS l, substr(t, s + length(f) + 1, 1) AS r, replace(f, ' ', '') AS bare, regexp_replace(f, '[^0-9]', '', 'g') AS d,
         translate(substr(t, greatest(0, s - {BEFORE}) + 1, s - greatest(0, s - {BEFORE})), '{UPPER}', '{LOWER}') AS b,
         translate(substr(t, s + length(f) + 1, {AFTER}), '{UPPER}', '{LOWER}') AS a
  FROM matches
), right_ones AS (
  SELECT doc_id, kind, place, base, s, e, round(least(1, greatest(0, begun + {CONFIRMED} * checksum::INT + {NEAR} * (regexp_matches(b, words) OR regexp_matches(a, words))::INT
         - {AGAINST} * (regexp_matches(b, '(^|[^a-z])({UNLIKE})([^a-z]|$)') OR regexp_matches(a, '(^|[^a-z])({UNLIKE})([^a-z]|$)'))::INT))::DOUBLE, 2) AS score
  FROM near WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(f, '.'), lambda x: length(ltrim(x, '0')) < 3 OR length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255'))
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE
         WHEN k % 2 = 1 THEN substr(d, -k, 1)::INT ELSE 2 * substr(d, -k, 1)::INT - CASE WHEN substr(d, -k, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'iban' THEN NOT regexp_matches(l, '[A-Za-z0-9]') AND NOT regexp_matches(r, '[A-Za-z0-9]') AND list_reduce(list_prepend(0, list_transform(
         string_split(bare[5:] || bare[:4], ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda x, y: (x * CASE WHEN y < 10 THEN 10 ELSE 100 END + y) % 97) = 1
    WHEN 'ssn' THEN f[:3] NOT IN ('000', '666') AND f[1] <> '9' AND f[5:6] <> '00' AND f[8:] <> '0000' AND NOT regexp_matches(l, '[0-9-]') AND NOT regexp_matches(r, '[0-9-]')
    ELSE NOT regexp_matches(l, '[0-9+(-]') AND NOT regexp_matches(r, '[0-9-]') END
), kept AS (
  SELECT * FROM right_ones x WHERE base OR score >= {THRESHOLD} AND NOT EXISTS (FROM right_ones y WHERE y.base AND y.doc_id = x.doc_id AND y.s <= x.s AND y.e >= x.e)
)
SELECT docs.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place), '') AS spans, coalesce(string_agg(format('{{:.2f}}', score), ',' ORDER BY s, place), '') AS scores
FROM docs LEFT JOIN kept USING (doc_id) GROUP BY docs.doc_id
"""
