import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from labspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """DataFrame -> list of dicts, sorted by the given columns."""
    def collect(df, *sort):
        out = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(out, key=lambda r: tuple(str(r[c]) for c in sort)) if sort else out
    return collect


LAB_ROWS = [
    ("p001_c1", "p001", "v001", "GLU", "7.8", "mmol/L", "2026-01-01"),
    ("p001_c1", "p001", "v001", "GLU", "8.6", "mmol/L", "2026-02-01"),
    ("p001_c1", "p001", "v001", "GLU", "9.8", "mmol/L", "2026-03-01"),
    ("p001_c1", "p001", "v001", "HbA1c", "8.2", "%", "2026-03-01"),
    ("p001_c1", "p001", "v001", "WBC", "6.1", "10^9/L", "2026-03-01"),
    ("p001_c1", "p001", "v001", "Creatinine", "88", "μmol/L", "2026-03-01"),
    ("p002_c1", "p002", "v001", "GLU", "5.4", "mmol/L", "2026-01-01"),
    ("p002_c1", "p002", "v001", "HbA1c", "5.8", "%", "2026-01-01"),
    ("p002_c1", "p002", "v001", "WBC", "5.9", "10^9/L", "2026-01-01"),
    ("p002_c1", "p002", "v001", "Creatinine", "180", "μmol/L", "2026-01-01"),
    ("p003_c1", "p003", "v001", "WBC", "6.0", "10^9/L", "2026-01-01"),
    ("p003_c1", "p003", "v001", "HGB", "130", "g/L", "2026-01-01"),
    ("p003_c1", "p003", "v001", "PLT", "220", "10^9/L", "2026-01-01"),
]


@pytest.fixture(scope="session")
def raw_labs(spark):
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(LAB_ROWS)],
        "case_id string, patient_id string, visit_id string, item_name string, value string,"
        " unit string, test_time string, ord long")
