"""The library stands without its llm subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_llm():
    for p in ROOT.rglob("*.py"):
        parts = p.relative_to(ROOT).parts
        if parts[0] in ("corpus_pipeline.py", "__spark_entry__.py") or "llm" in parts:
            continue
        assert not re.search(r"quirefold(\.|\s+import\s+)llm|corpus_pipeline\s+import|import\s+corpus_pipeline", p.read_text().replace(__file__, "")) or p == Path(__file__), p
