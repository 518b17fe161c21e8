import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


def pytest_collection_modifyitems(items):
    if not Path("/root/testdata/sf0.001").exists():
        for item in items:
            if "/llm/" in str(item.fspath):
                item.add_marker(pytest.mark.skip(reason="the driver's tables are absent"))
