import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ruleloom.session import local_session

    session = local_session(cores=8, shuffle_partitions=4, app="ruleloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def transactions(spark):
    """Build one-bag transactions from [(items, label), ...]."""

    def build(records, bags=None):
        rows = [
            (i, list(items), label, bags[i] if bags else 0) for i, (items, label) in enumerate(records)
        ]
        kind = "string" if isinstance(rows[0][1][0], str) else "bigint"
        label_kind = "string" if isinstance(rows[0][2], str) else "bigint"
        schema = f"rec_id bigint, items array<{kind}>, label {label_kind}, bag_id int"
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def lines():
    """Rendered rules of a rule table, in model order."""
    from ruleloom.operators.rules import rules_text

    def render(rules):
        rows = rules_text(rules).orderBy("bag_id", "level", "rank").collect()
        return [r["line"] for r in rows]

    return render
