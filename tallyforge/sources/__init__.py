"""Log formats that become usage facts."""

from . import claude, codex, cursor, grok, kimi
from .base import Registry

SOURCES = Registry({s.SOURCE.name: s.SOURCE for s in (claude, codex, cursor, grok, kimi)})
