from __future__ import annotations

import pytest

from tidemark.session import create_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = create_session(
        "tidemark-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
