"""Settings: the environment, completed by files, and typed getters."""

from __future__ import annotations

import os
import re
from collections.abc import MutableMapping

#: Files that complete the environment, the first one's lines before the second's; and what counts as true.
FILES, TRUE = (".env.local", ".env"), {"1", "true", "yes", "on"}


def load_env(folder: str, env: MutableMapping[str, str] = os.environ) -> None:
    """Names that ``env`` lacks from the files in ``folder``: lines ``name=value``, one pair of quotes taken off;
    blank lines, comments and lines without a name or ``=`` are skipped."""
    for path in (os.path.join(folder, f) for f in FILES):
        if not os.path.exists(path):
            continue
        with open(path, encoding="utf-8") as f:
            found = re.findall(r"(?m)^[^\S\n]*([^#=\s][^=\n]*?)[^\S\n]*=[^\S\n]*(.*?)[^\S\n]*$", f.read())
        for name, value in found:
            quoted = re.fullmatch(r"""(["'])(.*)\1""", value)
            env.setdefault(name, quoted[2] if quoted else value)


def _text(name: str, env) -> str:
    return env.get(name, "").strip()


def get_bool(name: str, default: bool = False, env=os.environ) -> bool:
    """A name that is there decides, even if empty."""
    return _text(name, env).lower() in TRUE if name in env else default


def get_str(name: str, default: str, env=os.environ) -> str:
    return _text(name, env) or default


def get_int(name: str, default: int, env=os.environ) -> int:
    text = _text(name, env)
    return int(text) if re.fullmatch(r"[+-]?\d+(?:_\d+)*", text) else default


def get_list(name: str, env=os.environ) -> list[str] | None:
    """The trimmed parts of a list with commas; null where nothing is set."""
    return [p.strip() for p in _text(name, env).split(",") if p.strip()] if _text(name, env) else None


def api_url(env=os.environ, prefix: str = "NEXT_PUBLIC_OCR_API_", host: str = "localhost", port: str = "8000") -> str:
    """The service's address, without a slash at its end: <prefix>URL, else <prefix>HOST and <prefix>PORT."""
    whole = get_str(prefix + "URL", "", env)
    if whole:
        return whole.rstrip("/")
    host = get_str(prefix + "HOST", host, env).rstrip("/")
    return f"{host if re.match('(?i)https?://', host) else 'http://' + host}:{get_str(prefix + 'PORT', port, env)}"
