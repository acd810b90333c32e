import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents from texts; ids from 0 unless given as pairs."""

    def make(*texts, **columns):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
        from pyspark.sql import functions as F

        # working names of the operators: they must not clash
        return df.withColumns({c: F.lit("clash") for c in ("fp", "anchor", "uid", "base", "marks", "p", "part", "length", "rank", "word", "bucket", "block", "lang_pred", "score", "row", "id", "content", "hash", "masked", "more", "first_id", "first_content", "n", "told", "seen", "__id", "__content", "__text_hash", "__masked", "__more", "__lang", "__blocks", "__pair")} | {k: F.lit(v) for k, v in columns.items()})

    return make
