"""Store settings from ``key=value`` files."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    backlog: int = 1000
    files_per_feature: int = 1

    @classmethod
    def load(cls, path: str) -> "Config":
        """Unknown keys, blank lines and lines without ``=`` are passed over; a bad number is a ValueError; relative folders start at the file's."""
        with open(path) as lines:
            said = dict(tuple(x.strip() for x in line.split("=", 1)) for line in lines if "=" in line and not line.lstrip().startswith("#"))
        out = cls()
        for f in fields(cls):
            if f.name in said:
                out = replace(out, **{f.name: int(said[f.name]) if isinstance(f.default, int) else said[f.name]})
        if "://" not in out.data_dir and not os.path.isabs(out.data_dir):
            out = replace(out, data_dir=os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), out.data_dir)))
        return out
