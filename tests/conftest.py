import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from spanledger.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
SPAN_TYPES = {
    "span_id": "STRING", "ord": "BIGINT", "operation": "STRING", "session_id": "STRING", "native_session_id": "STRING", "conversation_id": "STRING",
    "trace_id": "STRING", "parent_span_id": "STRING", "parent_known": "BOOLEAN", "model": "STRING", "start_ms": "BIGINT", "end_ms": "BIGINT",
    "input": "BIGINT", "output": "BIGINT", "cached": "BIGINT", "cache_write": "BIGINT", "reasoning": "BIGINT", "nano": "BIGINT", "sdk": "BOOLEAN",
    "sdk_nano": "BIGINT", "ttft_ms": "DOUBLE", "first_chunk_ms": "DOUBLE", "turns": "BIGINT", "tool": "STRING", "prompt_limit": "DOUBLE",
    "auxiliary": "BOOLEAN", "agent": "STRING", "parent_session_id": "STRING", "effort": "STRING", "repository": "STRING", "branch": "STRING",
    "user_name": "STRING", "user_source": "STRING", "actor_id": "STRING", "failed": "BOOLEAN", "host": "STRING",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_spans(spark):
    """Spans from dicts; a native chat also is the session, flags default to False."""
    def make(*rows):
        filled = []
        for i, given in enumerate(rows):
            row = {"ord": i, "operation": "chat", "sdk": False, "auxiliary": False, "parent_known": True, "start_ms": 1, **given}
            row.setdefault("end_ms", row["start_ms"])
            row.setdefault("session_id", row.get("native_session_id") or row.get("conversation_id"))
            filled.append(tuple(row.get(c) for c in SPAN_TYPES))
        return spark.createDataFrame(filled, ", ".join(f"{c} {t}" for c, t in SPAN_TYPES.items()))

    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
