import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Documents from texts; ids count up."""

    def make(texts, **extra):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
