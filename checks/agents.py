"""Golden answers for the agents dealt out in the test data."""

from __future__ import annotations

# browser, version, kind, platform; in the order of footfall.sources.testdata.AGENTS
ANSWERS = [
    ("Chrome", "130", 0, "win10"),
    ("Firefox", "121", 0, "win10"),
    ("Default Browser", "0", 2, "ios"),
    ("Chrome", "130", 2, "android"),
    ("Googlebot", "2.1", 1, "unknown"),
    ("BingBot", "2", 1, "unknown"),
    ("Default Browser", "0", 1, "unknown"),
    ("IE", "11", 0, "win7"),
    ("Firefox", "115", 0, "ubuntu"),
    ("Opera", "114", 0, "macosx"),
    ("curl", "8", 1, "unknown"),
    ("WordPress", "6.4", 3, "unknown"),
    ("Default Browser", "0", 1, "unknown"),
]
