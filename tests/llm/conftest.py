"""What a stage sets for its session does not reach the tests after it."""

import pytest

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(autouse=True)
def bound_of_the_session(request):
    if "spark" not in request.fixturenames:
        yield
        return
    session = request.getfixturevalue("spark")
    before = session.conf.get(BOUND)
    yield
    session.conf.set(BOUND, before)
