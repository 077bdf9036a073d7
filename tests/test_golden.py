"""Hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions.gaps import configured_gap, cprd_gap, elapsed_text, mimic_gap
from eventloom.functions.text import fixed_text, float_or_null, float_text, title_text
from eventloom.operators.ages import BinnedAge, DecimalAge, EthosQuantileAge, RawAge
from eventloom.operators.codes import CodeEnrichment, CodeTruncation
from eventloom.operators.filters import FilterEvents, TopKCodes
from eventloom.operators.measurements import DemographicAggregation
from eventloom.operators.phrases import EventPhrases
from eventloom.operators.sequence import DemographicSortOrder, RemoveNumeric, TimeIntervals, build_sequence
from eventloom.operators.static import clean_value, unmatched_mapping_keys
from eventloom.operators.tokens import Markers, string_sequences, token_rows
from eventloom.operators.values import QuantileBin, QuantileBin3Level, RoundNumeric
from eventloom.operators.word_vocab import WordLevel, decode

MINUTE, HOUR, DAY = 60, 3600, 86400


def values(spark, cells, kind, expression):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def codes(rows):
    return [r.code for r in sorted(rows.df.collect(), key=lambda r: tuple(r[c] for c in rows.order))]


def test_gap_tokens_before_each_event(make_events):
    events = make_events(
        [
            (7, None, "GENDER//f", None, None),
            (7, "1999-05-01 08:00:00", "ARRIVE", None, None),
            (7, "1999-05-01 08:01:00", "WEIGH", None, None),
            (7, "1999-05-01 08:21:00", "SAMPLE", 4.5, None),
            (7, "1999-05-01 08:21:00", "SAMPLE", 5.5, None),
            (7, "1999-05-03 10:00:00", "LEAVE", None, None),
        ]
    )
    ranges = {"short": {"min": 2, "max": 90}, "long": {"min": 90}}
    got = codes(TimeIntervals(ranges).apply(build_sequence(events)))
    short, long = "<time_interval_short>", "<time_interval_long>"
    assert got == ["GENDER//f", "ARRIVE", "WEIGH", short, "SAMPLE", "SAMPLE", long, "LEAVE"]


def test_birth_is_not_previous_unless_a_token_precedes_it(make_events):
    day = {"1d-": {"min": 1440}}
    first = make_events([(1, "2000-01-01", "MEDS_BIRTH", None, None), (1, "2030-01-01", "A", None, None)])
    assert codes(TimeIntervals(day).apply(build_sequence(first))) == ["MEDS_BIRTH", "A"]
    later = make_events(
        [(1, "2000-01-01", "A", None, None), (1, "2000-02-01", "MEDS_BIRTH", None, None), (1, "2000-02-01 05:00:00", "B", None, None)]
    )
    got = codes(TimeIntervals(day).apply(build_sequence(later)))
    assert got == ["A", "<time_interval_1d->", "MEDS_BIRTH", "B"]


def test_shared_edge_goes_to_the_first_range(spark):
    ranges = {"5m-15m": {"min": 5, "max": 15}, "15m-45m": {"min": 15, "max": 45}}
    gaps = [s * 1_000_000 for s in (15 * MINUTE, 4 * MINUTE + 59, 15 * MINUTE + 1, 46 * MINUTE)]
    assert values(spark, gaps, "bigint", lambda g: configured_gap(g, ranges)) == ["5m-15m", None, "15m-45m", None]


@pytest.mark.parametrize(
    "seconds, mimic, cprd",
    [
        (4 * MINUTE, None, None),
        (5 * MINUTE, "5 minutes", None),
        (59 * MINUTE + 59, "59 minutes", None),
        (60 * MINUTE, "1 hour", None),
        (23 * HOUR + 59 * MINUTE, "23 hours", None),
        (DAY, "1 day", "1 day"),
        (2.5 * DAY, "2 days", "2 days"),
        (3.5 * DAY, "3 days", "4 days"),
        (6.5 * DAY, "6 days", "6 days"),
        (6.9 * DAY, "6 days", "6 days"),
        (7 * DAY, "1 week", "1 week"),
        (13 * DAY, "1 week", "2 weeks"),
    ],
)
def test_dynamic_gaps(spark, seconds, mimic, cprd):
    gap = [int(seconds * 1_000_000)]
    assert values(spark, gap, "bigint", mimic_gap) == [mimic]
    assert values(spark, gap, "bigint", cprd_gap) == [cprd]


def test_ethos_digits(spark):
    op = EthosQuantileAge()
    df = spark.createDataFrame([(a,) for a in (0.0, 2.5, 9.6, 25.0, 47.0, 65.0, 85.0, 100.0)], "age double")
    first, second = op.digits(F.col("age"))
    got = [(r.a + 1, r.b + 1) for r in df.select("age", first.alias("a"), second.alias("b")).orderBy("age").collect()]
    assert got == [(1, 1), (1, 3), (2, 1), (3, 6), (5, 8), (7, 6), (9, 6), (10, 10)]


def aged(make_events, years):
    birth = "1950-01-01 00:00:00"
    from datetime import datetime, timedelta

    event = datetime(1950, 1, 1) + timedelta(seconds=years * 365.25 * DAY)
    return make_events([(1, birth, "MEDS_BIRTH", None, None), (1, event.isoformat(sep=" "), "LAB//1", 1.0, None)])


@pytest.mark.parametrize(
    "years, decimal, binned",
    [(45.2, ["Q4", "Q5"], "AGE: 45-49"), (19.9, ["Q1", "Q9"], None), (104.0, ["Q10", "Q4"], None)],
)
def test_other_ages(make_events, years, decimal, binned):
    events = aged(make_events, years)
    rows = DecimalAge().transform(events).where("time is null").orderBy("seq").collect()
    assert [r.text_value for r in rows] == decimal
    bins = [r.code for r in BinnedAge().transform(events).where("time is null").collect()]
    assert bins == ([binned] if binned else [])
    raw = RawAge().transform(events).where("code = 'AGE'").first()
    assert raw.numeric_value == round(years)


def test_raw_age_text_follows_the_value_column(make_events):
    events = aged(make_events, 45.2)
    text = RoundNumeric("starts_with", "LAB", "numeric_value").transform(events)
    assert RawAge().transform(text).where("code = 'AGE'").first().numeric_value == "45"
    assert RawAge(decimals=1).transform(text).where("code = 'AGE'").first().numeric_value == "45.2"


def test_subjects_without_birth_or_events(make_events):
    events = make_events([(1, "2020-01-01", "A", None, None), (2, "2000-01-01", "MEDS_BIRTH", None, None)])
    assert RawAge().transform(events).where("code = 'AGE'").count() == 0
    ethos = EthosQuantileAge().transform(events).where("time is null").collect()
    assert sorted((r.subject_id, r.text_value) for r in ethos) == [(2, "Q1"), (2, "Q1")]


def test_quantile_bins(make_events):
    train = make_events([(1, "2020-01-01", "LAB//1", float(v), None) for v in (1, 2, 3, 4, 5)])
    test = make_events(
        [(1, "2020-01-01", "LAB//1", v, None) for v in (0.0, 1.0, 2.0, 3.5, 4.0, 9.0)]
        + [(1, "2020-01-01", "LAB//2", 7.0, None), (1, "2020-01-01", None, 3.0, None), (1, "2020-01-01", "X", 3.0, None)]
    )
    got = QuantileBin("starts_with", "LAB", 4, "numeric_value").fit(train).transform(test).orderBy("seq").collect()
    assert [r.numeric_value for r in got] == ["Q0", "Q0", "Q1", "Q2", "Q3", "Q3", "7.0", "3.0", "3.0"]
    levels = make_events([(1, "2020-01-01", "LAB//1", v, None) for v in (1.9, 2.0, 4.0, 4.1)])
    got = QuantileBin3Level("equals", "LAB//1", "numeric_value").fit(train).transform(levels).orderBy("seq").collect()
    assert [r.numeric_value for r in got] == ["low", "normal", "normal", "high"]


def test_constant_values_fall_into_the_last_bin(make_events):
    events = make_events([(1, "2020-01-01", "LAB//1", 5.0, None)] * 3)
    got = QuantileBin("starts_with", "LAB", 4, "numeric_value").fit_transform(events).collect()
    assert {r.numeric_value for r in got} == {"Q3"}


def test_second_value_operator_leaves_labels(make_events):
    events = make_events([(1, "2020-01-01", "LAB//1", float(v), None) for v in range(8)])
    once = QuantileBin("starts_with", "LAB", 4, "numeric_value").fit_transform(events)
    twice = QuantileBin("contains", "LAB", 2, "numeric_value").fit(events).transform(once)
    assert once.select("seq", "numeric_value").exceptAll(twice.select("seq", "numeric_value")).count() == 0


def test_median_and_labels(make_events):
    events = make_events([(1, "2020-01-01", "BMI//x", v, None) for v in (22.1, 23.5, 22.8, 23.0)])
    op = DemographicAggregation(
        [{"token_pattern": "BMI//", "value_column": "numeric_value", "aggregation": "median", "token_prefix": "BMI//"}]
    )
    row = op.fit_transform(events).where("time is null").first()
    assert (row.code, row.text_value) == ("BMI", "22.9")
    with pytest.raises(ValueError):
        DemographicAggregation([{"token_pattern": "B", "value_column": "numeric_value", "aggregation": "sum"}])


def test_fixed_text(spark):
    cells = [0.25, 0.15, 0.35, 2.45, -0.04, 99.5, 1e7, 0.0]
    assert values(spark, cells, "double", lambda x: fixed_text(x, 1)) == [f"{c:.1f}" for c in cells]
    assert values(spark, cells, "double", lambda x: fixed_text(x, 0)) == [f"{c:.0f}" for c in cells]


def test_float_text(spark):
    cells = [45.0, 0.1, 12345678.0, 1e16, 1.5e22, 0.0001, 0.00001, 1.5e-7, -0.0, 123456789.125, float("nan"), float("-inf")]
    assert values(spark, cells, "double", float_text) == [str(c) for c in cells]
    texts = ["12", " 1.5 ", "1e3", ".5", "5.", "1_000", "1__0", "nan", "-INF", "1.0d", "0x1", "", "Q3", "+4"]

    def python(text):
        try:
            return str(float(text))
        except ValueError:
            return None

    assert values(spark, texts, "string", lambda x: float_text(float_or_null(x))) == [python(t) for t in texts]


def test_title(spark):
    cells = ["HBA1C x/y", "O2 SAT", "it's"]
    assert values(spark, cells, "string", title_text) == [c.title() for c in cells]


def test_elapsed(spark):
    cells = [0.0, 72_500_000.0, 45 * DAY * 1.0, 3.0 * HOUR, 90.0, 30.0]
    want = ["T0", "+2.3 years", "+45 days", "+3 hours", "+2 minutes", "+30 seconds"]
    assert values(spark, cells, "double", elapsed_text) == want


def test_remove_numeric(make_events):
    cells = ["123", "456.7", "-10.5", "low", "normal", "Q1", "AGE_20-24", "1e-05", "12.", " 7 "]
    events = make_events([(1, "2020-01-01", "C", None, c) for c in cells])
    kept = [r.text_value for r in RemoveNumeric().apply(build_sequence(events)).df.orderBy("seq").collect()]
    assert kept == ["low", "normal", "Q1", "AGE_20-24", "1e-05"]


def test_demographic_order(make_events):
    cells = ["RACE//WHITE", "AGE_T1//Q3", "GENDER//F", "MARITAL_STATUS//MARRIED", "BMI//Q5"]
    rows = [(1, None, "STATIC_DATA_NO_CODE", None, c) for c in cells] + [(1, "2020-01-01", "LAB//1", 1.0, None)]
    op = DemographicSortOrder(["BMI//", "GENDER//", "MARITAL_STATUS//", "AGE_T", "RACE//"])
    ordered = op.apply(build_sequence(make_events(rows)))
    texts = token_rows(ordered, Markers(False, False, False))
    line = string_sequences(texts).first().strings
    assert line == ["<start>", "BMI//Q5", "GENDER//F", "MARITAL_STATUS//MARRIED", "AGE_T1//Q3", "RACE//WHITE", "LAB//1", "1.0", "<end>"]


def test_static_cleaning(spark):
    lower = {"mappings": {"male": "M"}}
    assert unmatched_mapping_keys(lower) == ["male"]
    assert values(spark, [" male ", None], "string", lambda x: clean_value(x, lower)) == ["MALE", "UNKNOWN"]
    race = {"valid_values": ["WHITE", "BLACK"], "map_invalids_to": "RACE_UNKNOWN", "mappings": {"PORTUGUESE": "WHITE"}}
    got = values(spark, ["portuguese", "martian", None], "string", lambda x: clean_value(x, race))
    assert got == ["WHITE", "RACE_UNKNOWN", "RACE_UNKNOWN"]


def test_truncation_and_enrichment(spark, make_events):
    events = make_events([(1, "2020-01-01", c, None, None) for c in ("MEDICAL//A//1", "MEDS_BIRTH", "LAB//51237//mg/dL", "LAB//99999//u")])
    got = [r.code for r in CodeTruncation("contains", "//").transform(events).orderBy("seq").collect()]
    assert got == ["MEDICAL//A", "MEDS_BIRTH", "LAB//51237", "LAB//99999"]
    lookup = spark.createDataFrame(
        [(51237, "old", "x", 1), (51237, "Glucose", "Chemistry", 2)], "itemid bigint, label string, category string, file_order int"
    )
    op = CodeEnrichment("starts_with", "LAB//", lookup, "<LAB> {label} ({category}) </LAB>", "itemid")
    got = [r.code for r in op.fit_transform(events).orderBy("seq").collect()]
    assert got == ["MEDICAL//A//1", "MEDS_BIRTH", "<LAB> Glucose (Chemistry) </LAB>", "LAB//99999//u"]
    with pytest.raises(ValueError):
        CodeEnrichment("starts_with", "LAB//", lookup, "{nothing}", "itemid").fit(events)


def test_filter_and_inverse_partition_known_codes(make_events):
    events = make_events([(1, "2020-01-01", c, None, None) for c in ("LAB//1", "X", None, "")])
    dropped = FilterEvents("starts_with", "LAB//").transform(events)
    kept = FilterEvents("starts_with", "LAB//", invert="true").transform(events)
    assert dropped.count() + kept.count() == events.where("code is not null").count()
    with pytest.raises(ValueError):
        FilterEvents("sounds_like", "x")


def test_top_k_ties_go_to_the_first_code(make_events):
    events = make_events([(1, "2020-01-01", c, None, None) for c in ("LAB//b", "LAB//a", "LAB//c", "LAB//c", "OTHER")])
    got = [r.code for r in TopKCodes("starts_with", "LAB//", k=2).fit_transform(events).orderBy("seq").collect()]
    assert got == ["LAB//a", "LAB//c", "LAB//c", "OTHER"]


def test_vocabulary_of_five(spark, make_events):
    rows = [(1, "2020-01-01", c, None, None) for c in "aabbabc"]
    tokens = token_rows(build_sequence(make_events(rows)), Markers(False, False, False))
    tokenizer = WordLevel(5).train(tokens)
    got = sorted(map(tuple, tokenizer.vocab.collect()))
    assert got == [(0, "<unknown>", 1), (1, "<start>", 0), (2, "<end>", 0), (3, "a", 3), (4, "b", 3)]
    line = tokenizer.encode(tokens).first()
    assert line.tokens == [1, 3, 3, 4, 4, 3, 4, 0, 2]
    assert tokenizer.decode(tokenizer.encode(tokens)).first().text == "<start> a a b b a b <unknown> <end>"
    bad = spark.createDataFrame([(1, [1, 77])], "subject_id bigint, tokens array<int>")
    with pytest.raises(Exception, match="no entry for id"):
        decode(bad, tokenizer.vocab).collect()


def test_phrases(spark, make_events):
    labs = spark.createDataFrame([(51237, "Glucose", 1)], "itemid bigint, label string, file_order int")
    icd = spark.createDataFrame([("E11", "10", "Diabetes", 1)], "icd_code string, icd_version string, long_title string, file_order int")
    cases = [
        ("LAB//51237//mg/dL", 145.23, None, "Glucose 145.2 mg/dL"),
        ("LAB//51237//UNK", 145.23, None, "Glucose 145.2"),
        ("LAB//51237//mg/dL", None, "___", "Glucose "),
        ("LAB//51237//mg/dL", 1.0, "110/68", "Glucose 110/68 mg/dL"),
        ("LAB//x//mg", 2.0, None, "LAB//x//mg 2.0"),
        ("LAB//7", 2.0, None, "7 2.0"),
        ("MEDICATION//START//drug1", None, None, "start drug1"),
        ("MEDICATION//STOP//drug1", None, None, "STOP drug1"),
        ("GENDER//F", None, None, "Female"),
        ("GENDER//M", None, None, "Male"),
        ("RACE//RACE_BLACK_AFRICAN", None, None, "Race Black African"),
        ("MARITAL_STATUS//single", None, None, "SINGLE"),
        ("DIAGNOSIS//ICD//10//X1", None, None, "X1"),
        ("DIAGNOSIS//ICD//10//E11", None, None, "Diabetes"),
        ("DIAGNOSIS//ICD//10", None, None, "DIAGNOSIS//ICD//10"),
        ("HOSPITAL_ADMISSION//ED", None, None, "HOSPITAL ADMISSION to ED"),
        ("Blood Pressure", None, "110/68", "Blood Pressure 110/68"),
        ("OTHER//a_b", 3.0, None, "OTHER a b 3.0"),
        (None, None, None, "None"),
    ]
    events = make_events([(1, "2020-01-01", c, n, t) for c, n, t, _ in cases])
    got = [r.phrase for r in EventPhrases(labs, icd, icd).translate(events).orderBy("seq").collect()]
    assert got == [want for *_, want in cases]


def test_end_time_and_empty_subject(make_events):
    rows = [(1, "2020-01-02", "A", None, None), (1, "2020-01-03", None, None, None), (2, None, "STATIC_DATA_NO_CODE", None, None)]
    df = string_sequences(token_rows(build_sequence(make_events(rows)), Markers(False, False, False)))
    lines = {r.subject_id: (r.strings, r.timestamps) for r in df.collect()}
    assert lines[1] == (["<start>", "A", "<end>"], [0.0, 1577923200.0, 1578009600.0])
    assert lines[2] == (["<start>", "<end>"], [0.0, 0.0])
