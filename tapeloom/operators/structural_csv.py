"""Delimited lines to typed rows, with the lines that fail set apart with a reason.

The bytes of a whole Arrow batch are looked at at once. A mask of the quote bytes, turned into a running parity, tells
which commas and line ends lie outside of quotes; these are the field and record boundaries. Everything that follows
(field count, value checks, typing) works on vectors of field positions. There is no loop over lines.

``structural_index`` also takes a whole file's bytes, in which records end at line feeds outside of quotes.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

QUOTE, COMMA, LF = 0x22, 0x2C, 0x0A
WHITE = " \t\r\n"
INT64_MAX = "9223372036854775807"

#: The fields of one provider line, in order.
MBO_FIELDS = (
    "ts_recv", "ts_event", "rtype", "publisher_id", "instrument_id", "action", "side", "price", "size",
    "channel_id", "order_id", "flags", "ts_in_delta", "sequence", "symbol",
)
ACTIONS = ("A", "C", "M", "R", "T", "F", "N")
EMPTY_PRICE_ACTIONS = ("N", "R")
REASONS = ("quoting", "column_count", "ts_recv", "action", "price", "sequence")


@dataclass
class Structure:
    """Where records and their fields lie in ``data``. Field f of record r is field ``first_field[r] + f``."""

    data: np.ndarray
    first_field: np.ndarray  # per record, with one more at the end
    start: np.ndarray  # per field
    end: np.ndarray
    quoted: np.ndarray  # per field: it starts with a quote
    sound: np.ndarray  # per record: its quoting is sound

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first_field)


def structural_index(data: np.ndarray, offsets: np.ndarray | None = None) -> Structure:
    """Locate fields. offsets: the records' bounds (n + 1 of them); without it they are found at line feeds outside of quotes.

    A record's quoting is sound if every field that holds a quote starts and ends with one and has only doubled quotes
    between. For sound records the parity gives the same fields as reading them byte by byte; of others only the first
    failing field matters, and up to there both agree.
    """
    is_quote = data == QUOTE
    running = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_quote, out=running[1:])
    if offsets is None:
        ends = np.flatnonzero((data == LF) & (running[:-1] & 1 == 0))
        last = len(data)
        bounds_start = np.concatenate(([0], ends + 1))
        bounds_end = np.concatenate((ends, [last]))
        if bounds_start[-1] == last:  # nothing follows the last line feed
            bounds_start, bounds_end = bounds_start[:-1], bounds_end[:-1]
        if len(bounds_end):  # a carriage return before the line feed belongs to the record's end
            has = bounds_end > bounds_start
            cr = np.zeros(len(bounds_end), bool)
            cr[has] = data[bounds_end[has] - 1] == 0x0D
            bounds_end = bounds_end - cr
    else:
        bounds_start, bounds_end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    n = len(bounds_start)
    commas = np.flatnonzero(data == COMMA)
    owner = np.searchsorted(bounds_start, commas, side="right") - 1
    inside = (owner >= 0) & (commas < bounds_end[np.maximum(owner, 0)]) if n else np.zeros(len(commas), bool)
    commas, owner = commas[inside], owner[inside]
    outside = (running[commas] - running[bounds_start[owner]]) & 1 == 0
    commas, owner = commas[outside], owner[outside]
    per_record = np.bincount(owner, minlength=n) + 1 if n else np.zeros(0, np.int64)
    first_field = np.concatenate(([0], np.cumsum(per_record))).astype(np.int64)
    total = int(first_field[-1])
    start, end = np.empty(total, np.int64), np.empty(total, np.int64)
    slot = np.arange(len(commas)) + owner  # each earlier record adds one more field than commas
    start[first_field[:-1]] = bounds_start
    end[first_field[1:] - 1] = bounds_end
    start[slot + 1] = commas + 1
    end[slot] = commas

    filled = end > start
    at = np.minimum(start, max(len(data) - 1, 0))
    quoted = filled & (is_quote[at] if len(data) else False)
    has_quote = running[end] - running[start] > 0
    closed = quoted & (end - start >= 2)
    closed[closed] = is_quote[end[closed] - 1]
    bad = has_quote & ~closed
    # between the opening and the closing quote there may only be runs of even length
    inner = is_quote.copy()
    inner[start[closed]] = False
    inner[end[closed] - 1] = False
    q = np.flatnonzero(inner)
    if len(q):
        field = np.searchsorted(start, q, side="right") - 1
        breaks = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1] + 1) | (field[1:] != field[:-1]))))
        odd = np.diff(np.concatenate((breaks, [len(q)]))) & 1 == 1
        bad[field[breaks[odd]]] = True
    sound = np.ones(n, bool)
    sound[np.repeat(np.arange(n), per_record)[bad]] = False
    return Structure(data, first_field, start, end, quoted, sound)


def column(s: Structure, records: np.ndarray, f: int) -> pa.Array:
    """Field f of the given sound records as strings, without quotes and outer white space."""
    k = s.first_field[:-1][records] + f
    quoted = s.quoted[k]
    start, end = s.start[k] + quoted, s.end[k] - quoted
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    flat = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    out = pa.Array.from_buffers(pa.large_utf8(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(s.data[flat].tobytes())])
    if quoted.any():
        out = pc.if_else(pa.array(quoted), pc.replace_substring(out, '""', '"'), out)
    return pc.utf8_trim(out, WHITE)


def _full(array: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(array, rf"\A(?:{pattern})\z"))


def whole_number(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits alone, below 2^63: (is one, its value or 0)."""
    ok = _full(text, "[0-9]+")
    bare = pc.utf8_ltrim(text, "0")
    size = np.asarray(pc.utf8_length(bare))
    ok &= size <= 19
    ok &= (size < 19) | np.asarray(pc.less_equal(bare, INT64_MAX))
    value = pc.if_else(pa.array(ok & (size > 0)), bare, pa.scalar("0", pa.large_utf8()))
    return ok, np.asarray(pc.cast(value, pa.int64()))


def _civil_days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    return ((y - 1970) * 12 + m - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})"


def instant_micros(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole nanoseconds since 1970 or an existing ISO time with its offset: (is one, microseconds since 1970 or 0)."""
    ok, nanos = whole_number(text)
    micros = nanos // 1000
    iso = _full(text, ISO)
    which = np.flatnonzero(iso)
    if not len(which):
        return ok, micros
    t = pc.take(text, pa.array(which))

    def part(a: int, b: int) -> np.ndarray:
        return np.asarray(pc.cast(pc.utf8_slice_codeunits(t, a, b), pa.int64()))

    y, mo, d, h, mi, sec = (part(*x) for x in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    rest = pc.utf8_slice_codeunits(t, 19)
    fraction = pc.struct_field(pc.extract_regex(rest, r"\A(?P<f>(?:\.[0-9]*)?)"), "f")
    digits = pc.utf8_rpad(pc.utf8_ltrim(fraction, "."), 6, "0")
    us = np.asarray(pc.cast(digits, pa.int64()))
    utc = np.asarray(pc.ends_with(rest, "Z"))
    zone = pc.if_else(pa.array(utc), pa.scalar("+00:00", pa.large_utf8()), pc.utf8_slice_codeunits(pc.cast(rest, pa.large_utf8()), -6))
    sign = np.where(np.asarray(pc.starts_with(zone, "-")), -1, 1)
    zh, zm = (np.asarray(pc.cast(pc.utf8_slice_codeunits(zone, *x), pa.int64())) for x in ((1, 3), (4, 6)))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    month_days = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    real_month = (mo >= 1) & (mo <= 12)
    longest = month_days[np.where(real_month, mo, 1) - 1] + (leap & (mo == 2))
    exists = (y >= 1) & real_month & (d >= 1) & (d <= longest) & (h <= 23) & (mi <= 59) & (sec <= 59) & (zh <= 23) & (zm <= 59)
    days = _civil_days(np.where(exists, y, 1970), np.where(exists, mo, 1), np.where(exists, d, 1))
    value = ((days * 24 + h - sign * zh) * 60 + mi - sign * zm) * 60 + sec
    ok, micros = ok.copy(), micros.copy()
    ok[which] = exists
    micros[which] = np.where(exists, value * 1_000_000 + us, 0)
    return ok, micros


NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def positive_number(text: pa.Array) -> np.ndarray:
    """A decimal number above zero: no minus sign, and a digit above zero before any exponent."""
    return _full(text, NUMBER) & ~np.asarray(pc.starts_with(text, "-")) & _full(text, r"[^eE]*[1-9](?:.|\n)*")


def first_reason(s: Structure) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """(per record the index in REASONS or -1, records that reached the value checks, their columns by name)."""
    n = len(s.sound)
    reason = np.full(n, -1, np.int8)
    reason[s.counts != len(MBO_FIELDS)] = 1
    reason[~s.sound] = 0
    rows = np.flatnonzero(reason < 0)
    cols = {name: column(s, rows, f) for f, name in enumerate(MBO_FIELDS)}
    recv_ok, recv = instant_micros(cols["ts_recv"])
    event_ok, event = instant_micros(cols["ts_event"])
    action = pc.utf8_upper(cols["action"])
    price = cols["price"]
    blank = np.asarray(pc.equal(price, "")) & np.asarray(pc.is_in(action, pa.array(EMPTY_PRICE_ACTIONS, pa.large_utf8())))
    sequence_ok, sequence = whole_number(cols["sequence"])
    fails = (
        (2, ~recv_ok | (event_ok & (recv < event))),
        (3, ~_full(cols["action"], f"[{''.join(ACTIONS)}{''.join(ACTIONS).lower()}]")),
        (4, ~(positive_number(price) | blank)),
        (5, ~sequence_ok),
    )
    for code, failed in reversed(fails):
        reason[rows[failed]] = code
    cols |= {"recv_us": pa.array(recv), "event_us": pa.array(event, mask=~event_ok), "action": action, "sequence_n": pa.array(sequence)}
    return reason, rows, cols


def _long(text: pa.Array) -> pa.Array:
    """Whole numbers with an optional sign that fit in 64 bits, else null."""
    digits = pc.replace_substring_regex(text, r"^[+-]", "")
    ok, value = whole_number(digits)
    value = np.where(np.asarray(pc.starts_with(text, "-")), -value, value)
    return pa.array(value, mask=~ok)


PRICE_TYPE = pa.decimal128(38, 9)


def _price(text: pa.Array) -> pa.Array:
    """Decimal with nine places; null where empty or not held exactly (price_text keeps what was written)."""
    plain = _full(text, r"\+?[0-9]{0,25}(?:\.[0-9]{0,9})?") & _full(text, r"(?:.|\n)*[0-9](?:.|\n)*")
    simple = pc.if_else(pa.array(plain), pc.utf8_ltrim(text, "+"), pa.scalar(None, pa.large_utf8()))
    out = pc.cast(pc.cast(simple, pa.utf8()), PRICE_TYPE)
    odd = np.flatnonzero(~plain & _full(text, NUMBER))
    if not len(odd):
        return out
    with localcontext() as context:
        context.prec = 60
        fixed: list[Decimal | None] = out.to_pylist()
        for i in odd.tolist():
            value = Decimal(text[i].as_py())
            if value.is_zero():
                fixed[i] = Decimal(0)
            elif -10 < value.adjusted() < 29 and (exact := value.quantize(Decimal(1).scaleb(-9))) == value:
                fixed[i] = exact
    return pa.array(fixed, PRICE_TYPE)


PARSED = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("ts_recv", T.TimestampType()),
        T.StructField("ts_event", T.TimestampType()),
        *[T.StructField(x, T.LongType()) for x in ("rtype", "publisher_id", "instrument_id")],
        T.StructField("action", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("price", T.DecimalType(38, 9)),
        T.StructField("price_text", T.StringType()),
        *[T.StructField(x, T.LongType()) for x in ("size", "channel_id")],
        T.StructField("order_id", T.StringType()),
        *[T.StructField(x, T.LongType()) for x in ("flags", "ts_in_delta", "sequence")],
        T.StructField("symbol", T.StringType()),
    ]
)


def line_structure(lines: pa.Array) -> Structure:
    """The structure of an Arrow string array; a null is an empty line."""
    lines = pc.fill_null(lines, "").cast(pa.large_utf8())
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    raw = lines.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return structural_index(data[base : int(offsets[-1]) if len(offsets) else 0], offsets - base)


def parse_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row of PARSED for each row (record_id, raw_line)."""
    s = line_structure(batch.column(1))
    reason, rows, c = first_reason(s)
    good = reason[rows] < 0
    back = np.full(len(reason), -1, np.int64)
    back[rows[good]] = np.flatnonzero(good)
    at = pa.array(back, mask=back < 0)
    stamp = pa.timestamp("us", tz="UTC")
    typed = {
        "ts_recv": c["recv_us"].cast(stamp),
        "ts_event": c["event_us"].cast(stamp),
        "sequence": c["sequence_n"],
        "price": _price(c["price"]),
        "price_text": c["price"],
        **{x: _long(c[x]) for x in ("rtype", "publisher_id", "instrument_id", "size", "channel_id", "flags", "ts_in_delta")},
        **{x: c[x] for x in ("action", "side", "order_id", "symbol")},
    }
    arrays = [batch.column(0).cast(pa.int64()), pa.array([None, *REASONS]).take(pa.array(reason.astype(np.int64) + 1))]
    for f in PARSED.fields[2:]:
        a = typed[f.name].take(at)
        arrays.append(a.cast(pa.utf8()) if pa.types.is_large_string(a.type) else a)
    return pa.RecordBatch.from_arrays(arrays, names=PARSED.names)


def rejects_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Only (record_id, reason) of the lines that fail."""
    reason, _, _ = first_reason(line_structure(batch.column(1)))
    bad = np.flatnonzero(reason >= 0)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).cast(pa.int64()).take(pa.array(bad)), pa.array(REASONS).take(pa.array(reason[bad].astype(np.int64)))],
        names=["record_id", "reason"],
    )


def parse_lines(df: DataFrame, record_id: str = "record_id", raw_line: str = "raw_line") -> DataFrame:
    """Every line as a row of PARSED: typed with a null reason, or all null but for record_id and the reason.

    A null or empty line has one empty field and so the reason column_count; repeated lines stay repeated; an empty
    table gives an empty one. Other columns of df aren't carried, so their names cannot clash. One narrow pass without
    a shuffle.
    """
    return df.select(df[record_id].cast("long").alias("record_id"), df[raw_line].alias("raw_line")).mapInArrow(lambda it: map(parse_batch, it), PARSED)


def split_lines(df: DataFrame, record_id: str = "record_id", raw_line: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """(typed valid rows, rejects with record_id and reason); see parse_lines for the edge cases."""
    narrow = df.select(df[record_id].cast("long").alias("record_id"), df[raw_line].alias("raw_line"))
    rejects = narrow.mapInArrow(lambda it: map(rejects_batch, it), "record_id long, reason string")
    return parse_lines(df, record_id, raw_line).where("reason IS NULL").drop("reason"), rejects
