"""Strict configuration files and checksum lists, read on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key is repeated")
    return found


def load_config(path: str | Path) -> dict[str, object]:
    """A mapping from JSON, or from YAML where a YAML library is installed; repeated keys are an error."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("no YAML library here; use JSON") from error

        class Strict(yaml.SafeLoader):
            pass

        def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict[str, object]:
            return _unique([(loader.construct_object(k), loader.construct_object(v, deep=True)) for k, v in node.value])

        Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
        found = yaml.load(text, Loader=Strict)
    else:
        found = json.loads(text, object_pairs_hook=_unique)
    if not isinstance(found, dict):
        raise ValueError("a configuration is a mapping")
    return found


def checksum_list(text: str) -> dict[str, str]:
    """File names and their SHA-256 from lines of digest and name."""
    found: dict[str, str] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        m = re.fullmatch(r"([0-9a-f]{64}) [ *](\S+)", line)
        if not m or m[2] in found:
            raise ValueError(f"not a checksum line: {line[:80]}")
        found[m[2]] = m[1]
    return found


def verify_files(folder: str | Path, checksums: dict[str, str]) -> list[str]:
    """Names that are missing or have another digest."""
    bad = []
    for name, expected in checksums.items():
        path = Path(folder) / name
        if not path.is_file() or hashlib.sha256(path.read_bytes()).hexdigest() != expected:
            bad.append(name)
    return bad
