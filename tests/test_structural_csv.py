import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.operators.structural_csv import column, parse_lines, split_lines, structural_index

HEAD = "1673366141000046003,1673366140999324002,160,2,439"
GOOD = HEAD + ",C,B,263.33,100,1,b701248,128,1000,701264,DCN"


def line(**changed):
    f = GOOD.split(",")
    names = "ts_recv ts_event rtype publisher_id instrument_id action side price size channel_id order_id flags ts_in_delta sequence symbol".split()
    for k, v in changed.items():
        f[names.index(k)] = v
    return ",".join(f)


CASES = [
    (GOOD, None),
    (None, "column_count"),
    ("", "column_count"),
    (GOOD + ",x", "column_count"),
    (GOOD.replace(",", ";"), "column_count"),
    (line(symbol='"A,B"'), None),
    (line(symbol='"A""B"'), None),
    (line(symbol='"A"B"'), "quoting"),
    (line(symbol='"""'), "quoting"),
    (line(symbol='""'), None),
    (line(symbol='A"B"'), "quoting"),
    (line(symbol=' "A"'), "quoting"),
    (line(action='"C'), "quoting"),
    (",".join(f'"{x}"' for x in GOOD.split(",")), None),
    (line(ts_recv="2023-01-10T15:55:41Z", ts_event="2023-01-10 10:55:40.5-05:00"), None),
    (line(ts_recv="2023-02-29T15:55:41Z"), "ts_recv"),
    (line(ts_recv="2024-02-29T15:55:41Z"), None),
    (line(ts_recv="2024-02-29T24:00:00Z"), "ts_recv"),
    (line(ts_recv="2024-02-29T15:55:41"), "ts_recv"),
    (line(ts_recv="2024-02-29T15:55:41.1234567Z"), "ts_recv"),
    (line(ts_recv="9223372036854775808"), "ts_recv"),
    (line(ts_recv="0009223372036854775807"), None),
    (line(ts_recv="1673366140999323999"), "ts_recv"),
    (line(ts_recv="1673366140999324001"), None),  # earlier only in nanoseconds
    (line(ts_recv="+1673366141000046003"), "ts_recv"),
    (line(ts_recv="١٦٧٣٣٦٦١٤١٠٠٠٠٤٦٠٠٣"), "ts_recv"),
    (line(action="c"), None),
    (line(action="CC"), "action"),
    (line(action=""), "action"),
    (line(price="0"), "price"),
    (line(price="-1"), "price"),
    (line(price="+1.5E+2"), None),
    (line(price="1e"), "price"),
    (line(price="1e-400"), None),
    (line(price="."), "price"),
    (line(price=".5"), None),
    (line(price="5."), None),
    (line(price=""), "price"),
    (line(price="", action="r"), None),
    (line(price="x", action="N"), "price"),
    (line(price="nan"), "price"),
    (line(sequence=" 12\t"), None),
    (line(sequence=""), "sequence"),
    (line(sequence="-1"), "sequence"),
    (line(sequence="9223372036854775808"), "sequence"),
    (line(price="x", sequence="x"), "price"),
    (line(symbol="x" * 1_000_000), None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, (x, _) in enumerate(CASES)] + [(len(CASES), GOOD, None)], "record_id long, raw_line string, reason string")
    got = {r.record_id: r.reason for r in parse_lines(df).select("record_id", "reason").collect()}
    assert got == dict(enumerate([w for _, w in CASES] + [None]))
    valid, rejects = split_lines(df)
    assert {r.record_id: r.reason for r in rejects.collect()} == {i: w for i, w in got.items() if w}
    row = valid.where("record_id = 0").first()
    assert (row.action, str(row.price), row.size, row.sequence, row.symbol) == ("C", "263.330000000", 100, 701264, "DCN")
    assert valid.where(f"record_id = {CASES.index((line(price='1e-400'), None))}").first().price is None
    assert str(valid.where(f"record_id = {CASES.index((line(price='+1.5E+2'), None))}").first().price) == "150.000000000"


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, raw_line string")
    assert parse_lines(df).count() == 0


def by_hand(text):
    """Records and fields read byte by byte; None for a record whose quoting is broken."""
    out, fields, i = [], [], 0
    while True:
        if text[i : i + 1] == '"':
            j, value = i + 1, ""
            while True:
                if j >= len(text):
                    return out + [None]
                if text[j] == '"' and text[j + 1 : j + 2] == '"':
                    value, j = value + '"', j + 2
                elif text[j] == '"':
                    break
                else:
                    value, j = value + text[j], j + 1
            i = j + 1
            if text[i : i + 1] not in (",", "\n", ""):
                return out + [None]
        else:
            j = i
            while j < len(text) and text[j] not in ",\n":
                j += 1
            value, i = text[i:j], j
            if '"' in value:
                return out + [None]
        fields.append(value)
        if i >= len(text):
            return out + [fields]
        if text[i] == "\n":
            out, fields = out + [fields], []
            if i + 1 >= len(text):
                return out
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a,"\n', min_size=1, max_size=30))
def test_structure_of_whole_text(text):
    s = structural_index(np.frombuffer(text.encode(), np.uint8))
    want = by_hand(text)
    for r, fields in enumerate(want):
        assert bool(s.sound[r]) == (fields is not None)
        if fields is None:
            break
        assert s.counts[r] == len(fields)
        for f, value in enumerate(fields):
            assert column(s, np.array([r]), f)[0].as_py() == value.strip(" \t\r\n")


@pytest.mark.parametrize("text", ["", "\n", "a\r\nb"])
def test_record_ends(text):
    s = structural_index(np.frombuffer(text.encode(), np.uint8))
    assert [int(x) for x in s.counts] == [1] * len(text.replace("\r", "").splitlines())
