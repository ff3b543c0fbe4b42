"""Settings: roots with their schedules, rules and saved searches, checked, and swapped in by revision."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import UTC, datetime, timedelta, tzinfo

from pyspark.sql import SparkSession

from shelfmark.operators import rules as X
from shelfmark.operators.search import valid_saved
from shelfmark.plans.language import QueryError, parse
from shelfmark.sources.staging import Folder

#: A rescan that fell due while nothing ran waits so many seconds after the start.
MISSED_DELAY = 600
MOST_FILTERS, MOST_BOOKMARKS, MOST_BYTES = 200, 1000, 4 << 20


@dataclass(frozen=True)
class Schedule:
    """When a root is read again in full: never, every so many seconds, or daily at a local time."""

    every: int | None = None
    daily: tuple[int, int] | None = (3, 0)

    def next_after(self, now: int, zone: tzinfo = UTC) -> int | None:
        """Epoch seconds of the first rescan after `now`."""
        if self.every is not None:
            return now + self.every
        if self.daily is None:
            return None
        local = datetime.fromtimestamp(now, zone)
        due = local.replace(hour=self.daily[0], minute=self.daily[1], second=0, microsecond=0)
        return int((due if due > local else due + timedelta(days=1)).timestamp())

    def checked(self) -> None:
        if self.every is not None and not 60 <= self.every <= 366 * 86_400:
            raise ValueError("An interval is between a minute and a year")
        if self.daily is not None and not (0 <= self.daily[0] < 24 and 0 <= self.daily[1] < 60):
            raise ValueError("Not a time of day")


@dataclass(frozen=True)
class Root:
    path: str
    enabled: bool = True
    recursive: bool = True
    monitor: bool = True
    keep_offline: bool = False
    schedule: Schedule = Schedule()


@dataclass(frozen=True)
class Settings:
    revision: int = 0
    roots: tuple[Root, ...] = ()
    rules: X.Rules = X.Rules(roots=())
    debounce_ms: int = 200
    fallback_seconds: int = 300
    removable_drives: bool = False
    filters: dict[str, str] = field(default_factory=dict)
    bookmarks: dict[str, str] = field(default_factory=dict)

    def enabled(self) -> list[str]:
        return [r.path for r in self.roots if r.enabled]

    def index_rules(self) -> X.Rules:
        return replace(self.rules, roots=tuple(self.enabled()))

    def checked(self) -> Settings:
        """These settings; ValueError where they can't be used."""
        paths = [r.path for r in self.roots]
        if any(a != b and X._inside(a, b) for a in paths for b in paths) or len(set(paths)) < len(paths):
            raise ValueError("Roots overlap")
        replace(self.rules, roots=tuple(paths)).checked()
        for r in self.roots:
            r.schedule.checked()
        if not 20 <= self.debounce_ms <= 60_000 or not 5 <= self.fallback_seconds <= 86_400:
            raise ValueError("A wait is out of its range")
        if len(self.filters) > MOST_FILTERS:
            raise ValueError(f"At most {MOST_FILTERS} filters")
        for names, most, what in ((self.filters, 64, "filter"), (self.bookmarks, 256, "bookmark")):
            for name in names:
                if not name.strip() or len(name.encode()) > most:
                    raise ValueError(f"A {what} needs a name of at most {most} bytes")
        try:
            valid_saved(self.bookmarks, MOST_BOOKMARKS)
            for q in self.filters.values():
                if not q.strip():
                    raise ValueError("A filter needs a search")
                parse(q)
        except QueryError as e:
            raise ValueError(str(e)) from e
        return self

    def fingerprint(self) -> str:
        """Of what decides which entries are indexed: a catalog made under another one is scanned anew."""
        roots = [asdict(replace(r, schedule=Schedule(None, None))) for r in self.roots]
        return hashlib.sha256(json.dumps([roots, asdict(self.rules)], sort_keys=True).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)


def _made(kind, values: dict):
    return kind(**{f.name: tuple(v) if isinstance(v := values[f.name], list) else v for f in fields(kind) if f.name in values})


def from_json(text: str) -> Settings:
    """Settings from their JSON; fields that are missing have their defaults, and unknown ones are left out."""
    try:
        d = json.loads(text)
        d["roots"] = [_made(Root, r | {"schedule": _made(Schedule, r.get("schedule", {}))}) for r in d.get("roots", [])]
        d["rules"] = _made(X.Rules, {"roots": []} | d.get("rules", {}))
        return _made(Settings, d).checked()
    except (TypeError, KeyError, AttributeError, json.JSONDecodeError) as e:
        raise ValueError("Settings can't be read") from e


class SettingsStore:
    """Settings in a folder, a file a revision; each is put in place by one rename that fails if it is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def load(self) -> Settings:
        found = [int(m[1]) for n in self.folder.files() if (m := re.fullmatch(r"settings-([0-9]+)[.]json", n))]
        if not found:
            return Settings()
        name = f"settings-{max(found)}.json"
        if self.folder.files()[name] > MOST_BYTES:
            raise ValueError("Settings are too large")
        return from_json(self.folder.read(name).decode())

    def save(self, expected: int, settings: Settings) -> Settings:
        """Save as the revision after `expected`; ValueError if someone else has saved since."""
        new = replace(settings.checked(), revision=expected + 1)
        if self.load().revision != expected or not self.folder.create(f"settings-{new.revision}.json", new.to_json().encode()):
            raise ValueError("The settings were changed elsewhere; load them again")
        return new


def deadlines(settings: Settings, walked: dict[str, int], now: int, zone: tzinfo = UTC) -> dict[str, int]:
    """When each enabled root is due next; one whose rescan was missed since it was walked, MISSED_DELAY from now."""
    out = {}
    for r in settings.roots:
        due = r.schedule.next_after(now, zone) if r.enabled else None
        missed = r.schedule.next_after(walked[r.path], zone) if r.enabled and r.path in walked else None
        if missed is not None and missed <= now:
            due = now + MISSED_DELAY
        if due is not None:
            out[r.path] = due
    return out


def with_drives(settings: Settings, points: list[str]) -> tuple[Settings, list[str]]:
    """Settings with removable drives that no root covers as further roots that keep their rows offline, and those drives."""
    if not settings.removable_drives:
        return settings, []
    new = []
    for p in sorted(points):
        if not any(X._inside(p, r) or X._inside(r, p) for r in [x.path for x in settings.roots] + new) and not any(X._inside(p, x) for x in settings.rules.own):
            new.append(p)
    return replace(settings, roots=(*settings.roots, *(Root(p, keep_offline=True) for p in new))), new
