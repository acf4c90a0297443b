import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given texts, ids from 1, with the extra columns that each operator must bear."""
    def make(texts, ids=None, langs=None, extra=()):
        rows = [(k, t, la, "s", len(t or ""), *[f"x{k}"] * len(extra))
                for k, t, la in zip(ids or range(1, len(texts) + 1), texts, langs or ["en"] * len(texts))]
        return spark.createDataFrame(rows, DOC + "".join(", `" + c.replace("`", "``") + "` string" for c in extra))
    return make
