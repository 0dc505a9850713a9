"""The line protocol: sessions in a mode, commands in, replies out.  No network; lines are strings."""

from __future__ import annotations

import re
import secrets
import string
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from .engine import Engine, PolicyReject
from .operators.suggest import SuggestError
from .schema import ItemError

#: Commands of each mode, usages, actions.
MODES = {
    "search": ("QUERY", "SUGGEST", "LIST", "PING", "HELP", "QUIT"),
    "ingest": ("PUSH", "POP", "COUNT", "FLUSHC", "FLUSHB", "FLUSHO", "PING", "HELP", "QUIT"),
    "control": ("TRIGGER", "INFO", "PING", "HELP", "QUIT"),
}
USAGES = {
    "QUERY": 'QUERY <collection> <bucket> "<terms>" [LIMIT(<count>)]? [OFFSET(<count>)]? [LANG(<locale>)]?',
    "SUGGEST": 'SUGGEST <collection> <bucket> "<word>" [LIMIT(<count>)]?',
    "LIST": "LIST <collection> <bucket> [LIMIT(<count>)]? [OFFSET(<count>)]?",
    "PUSH": 'PUSH <collection> <bucket> <object> "<text>" [LANG(<locale>)]?',
    "POP": 'POP <collection> <bucket> <object> "<text>"',
    "COUNT": "COUNT <collection> [<bucket> [<object>]?]?",
    "FLUSHC": "FLUSHC <collection>",
    "FLUSHB": "FLUSHB <collection> <bucket>",
    "FLUSHO": "FLUSHO <collection> <bucket> <object>",
    "TRIGGER": "TRIGGER [<action>]? [<data>]?",
    "INFO": "INFO",
    "PING": "PING",
    "HELP": "HELP [<manual>]?",
    "QUIT": "QUIT",
}
ACTIONS = {"consolidate": "TRIGGER consolidate", "backup": "TRIGGER backup <path>", "restore": "TRIGGER restore <path>"}
#: An action that sessions have on request.
MORE_ACTIONS = {"flush": "TRIGGER flush"}
LIMIT_MAX, OFFSET_MAX = 2**16 - 1, 2**32 - 1


class CommandError(Exception):
    """What is replied after ERR."""


def _invalid_format(usage: str) -> CommandError:
    return CommandError(f"invalid_format({usage})")


#: A quoted text ends at a quote that an even number of backslashes precedes and that a blank or the end follows.
_TEXT = re.compile(r'"(?:(?:[^"\\]|\\.)|"(?!\s|$))*"(?=\s|$)', re.S)
_META = re.compile(r"([^()]*)\(([^()]*)\)")


def unescape(text: str) -> str:
    r"""``\n`` is a line break, ``\"`` a quote; any other pair becomes one backslash (its second sign is lost)."""
    return re.sub(r"\\(.?)", lambda m: {"n": "\n", '"': '"'}.get(m[1], "\\"), text, flags=re.S)


def quoted(rest: str) -> tuple[str, str]:
    """The text at the start of rest, blanks evened out, and what follows it."""
    m = _TEXT.match(rest.lstrip())
    text = unescape(" ".join(m[0].split())[1:-1].strip()) if m and len(m[0]) > 1 else ""
    if not text:
        raise ValueError
    return text, rest.lstrip()[m.end() :]


def metas(rest: str, known: dict[str, Callable[[str], object]]) -> dict[str, object]:
    """``KEY(VALUE)`` parts; of several faults the last is told."""
    found, fault = {}, None
    for part in rest.split():
        m = _META.fullmatch(part)
        if not m:
            opened = "(" in part and part.endswith(")")
            key, value = (part[: part.index("(")], part[part.index("(") + 1 : -1]) if opened else ("?", part)
            fault = CommandError(f"invalid_meta_key({key}[{value}])")
        elif m[1] not in known:
            fault = CommandError(f"invalid_meta_key({m[1]}[{m[2]}])")
        else:
            try:
                found[m[1].lower()] = known[m[1]](m[2])
            except ValueError:
                fault = CommandError(f"invalid_meta_value({m[1]}[{m[2]}])")
    if fault:
        raise fault
    return found


def _number(most: int) -> Callable[[str], int]:
    def read(value: str) -> int:
        if not re.fullmatch(r"\+?[0-9]+", value) or int(value) > most:
            raise ValueError(value)
        return int(value)

    return read


def _language(value: str) -> str:
    """A language code in either case, or ``none``."""
    from .functions.langs import KNOWN

    if value != "none" and value.lower() not in KNOWN:
        raise ValueError(value)
    return value.lower()


_LIMIT, _OFFSET, _LANG = {"LIMIT": _number(LIMIT_MAX)}, {"OFFSET": _number(OFFSET_MAX)}, {"LANG": _language}


@dataclass(frozen=True)
class Form:
    """How a command's arguments are read: words, whether a quoted text follows, and which metas may."""

    words: tuple[int, int]
    text: bool = False
    metas: dict = field(default_factory=dict)

    def read(self, name: str, rest: str) -> tuple[list[str], str | None, dict]:
        usage, (least, most), words = _invalid_format(USAGES[name]), self.words, []
        while len(words) < most and (m := re.match(r"\s*(\S+)", rest)) and not (len(words) >= least and self.metas):
            words.append(m[1])
            rest = rest[m.end() :]
        if len(words) < least:
            raise usage
        text = None
        if self.text:
            try:
                text, rest = quoted(rest)
            except ValueError:
                raise usage from None
        if not self.metas and rest.strip():
            raise usage
        return words, text, metas(rest, self.metas)


FORMS = {
    "QUERY": Form((2, 2), True, _LIMIT | _OFFSET | _LANG),
    "SUGGEST": Form((2, 2), True, _LIMIT),
    "LIST": Form((2, 2), False, _LIMIT | _OFFSET),
    "PUSH": Form((3, 3), True, _LANG),
    "POP": Form((3, 3), True),
    "COUNT": Form((1, 3)),
    "FLUSHC": Form((1, 1)),
    "FLUSHB": Form((2, 2)),
    "FLUSHO": Form((3, 3)),
    "TRIGGER": Form((0, 3)),
    "INFO": Form((0, 0)),
    "PING": Form((0, 0)),
    "HELP": Form((0, 1)),
    "QUIT": Form((0, 0)),
}


class Session:
    """Lines go to :meth:`send`; ``START <mode> [password]`` comes first.

    more_actions: take ``TRIGGER flush`` too, which writes the state and takes the log out.
    """

    def __init__(self, engine: Engine, password: str | None = None, *, more_actions: bool = False):
        self.engine, self.password, self.mode, self.closed = engine, password, None, False
        self.actions = ACTIONS | (MORE_ACTIONS if more_actions else {})

    def send(self, line: str) -> list[str]:
        """The replies to a line; none to an empty one."""
        head, _, rest = line.strip().partition(" ")
        if self.closed or not head:
            return []
        if self.mode is None:
            return [self._start(line.split())]
        began, name = time.time(), head.upper()
        if self.engine.closing:
            return ["ERR shutting_down"]
        try:
            if name not in MODES[self.mode]:
                raise CommandError("unknown_command")
            return self._run(name, *FORMS[name].read(name, rest))
        except CommandError as e:
            return [f"ERR {e}"]
        except PolicyReject as e:
            return [f"ERR policy_reject({e})"]
        except (ItemError, SuggestError):
            return ["ERR query_error"]
        finally:
            self.engine.stats.record(time.time() - began)

    def _start(self, parts: list[str]) -> str:
        if parts[0].upper() != "START":
            self.closed = True
            return "ENDED not_recognized"
        if len(parts) < 2 or parts[1] not in MODES:
            self.closed = True
            return "ENDED invalid_mode"
        if self.password is not None and len(parts) < 3:
            self.closed = True
            return "ENDED authentication_required"
        if self.password is not None and not secrets.compare_digest(parts[2], self.password):
            self.closed = True
            return "ENDED authentication_failed"
        self.mode = parts[1]
        return f"STARTED {self.mode}"

    def _event(self, name: str, values: list[str]) -> list[str]:
        ident = "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(8))
        return [f"PENDING {ident}", " ".join(["EVENT", name, ident, *values])]

    def _run(self, name: str, words: list[str], text: str | None, meta: dict) -> list[str]:
        e = self.engine
        if name == "QUERY":
            return self._event(name, e.query(*words, text, meta.get("limit"), meta.get("offset", 0), meta.get("lang")))
        if name == "SUGGEST":
            return self._event(name, e.suggest(*words, text, meta.get("limit")))
        if name == "LIST":
            return self._event(name, e.list_terms(*words, meta.get("limit"), meta.get("offset", 0)))
        if name == "PUSH":
            e.push(*words, text, meta.get("lang"))
            return ["OK"]
        if name == "POP":
            return [f"RESULT {e.pop(*words, text)}"]
        if name == "COUNT":
            return [f"RESULT {e.count(*words)}"]
        if name.startswith("FLUSH"):
            return [f"RESULT {e.flush(*words)}"]
        if name == "TRIGGER":
            return [self._trigger(*words)]
        if name == "INFO":
            return ["RESULT " + " ".join(f"{k}({v})" for k, v in e.info().items())]
        if name == "HELP":
            if not words:
                return ["RESULT manuals(commands)"]
            if words[0] != "commands":
                raise CommandError("not_found")
            return [f"RESULT commands({', '.join(MODES[self.mode])})"]
        if name == "QUIT":
            self.closed = True
            return ["ENDED quit"]
        return ["PONG"]

    def _trigger(self, action: str | None = None, *data: str) -> str:
        if action is None:
            return f"RESULT actions({', '.join(self.actions)})"
        if (action := action.lower()) not in self.actions:
            raise CommandError("not_found")
        if len(data) != self.actions[action].count("<"):
            raise _invalid_format(self.actions[action])
        try:
            getattr(self.engine, {"flush": "compact"}.get(action, action))(*data)
        except Exception as e:
            raise CommandError("internal_error") from e
        return "OK"
