"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["bpe", "embeddings", "langid", "lines", "packing", "passages", "quality", "simhash", "toxicity", "warc"]


def queries() -> dict:
    found = {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        found |= {k: f for k, f in vars(module).items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracles() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), "ORACLES", {})
    return found
