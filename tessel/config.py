"""Settings from the environment, with the defaults of the command line."""

from __future__ import annotations

import os
from dataclasses import dataclass

from tessel.functions import constants as K


def number(text: str | None, default: int) -> int:
    """``text`` as an integer; missing or malformed is the default."""
    try:
        return int(text) if text is not None else default
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    index_path: str = "index"
    nlow: int = K.NLOW
    nhigh: int = K.NHIGH

    @classmethod
    def from_environment(cls, env: dict | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(env.get("INDEX_PATH", "index"), number(env.get("NLOW"), K.NLOW), number(env.get("NHIGH"), K.NHIGH))
