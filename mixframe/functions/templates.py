"""Templates in page source: where one begins and ends, its parameters, and the player block made of them.

Braces and brackets nest, which a pattern cannot follow, so a block is read character by character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .vocab import PLAYER_ORDER

ADDRESS = re.compile(r"(?:(\d+)\s*=\s*)?(https?://\S*)")
TITLE = re.compile(r"t(\d*)\s*=(.*)", re.S)
MODE = re.compile(r"mode\s*=(.*)", re.S)
EMPTY = re.compile(r"(?:\d+\s*=)?\s*")


def find_template(text: str, name: str) -> tuple[int, int] | None:
    """Begin and end of the first template of that name; None if it is not there or never closed."""
    for found in re.finditer(r"\{\{\s*" + re.escape(name) + r"(?=[\s|}])", text):
        depth, at = 0, found.start()
        while at < len(text):
            two = text[at : at + 2]
            if two in ("{{", "}}"):
                depth += 1 if two == "{{" else -1
                at += 2
                if depth == 0:
                    return found.start(), at
            else:
                at += 1
    return None


def parameters(block: str) -> list[str]:
    """The name and the parameters of a template as they are written: split at the bars of its own level."""
    parts, depth, begin, at, end = [], 0, 2, 2, len(block) - 2
    while at < end:
        two = block[at : at + 2]
        if two in ("{{", "[[", "}}", "]]"):
            depth += 1 if two in ("{{", "[[") else -1
            at += 2
            continue
        if block[at] == "|" and depth == 0:
            parts.append(block[begin:at])
            begin = at + 1
        at += 1
    return [*parts, block[begin:end]]


@dataclass
class Player:
    """A player block: addresses with their titles (None: none written), the mode, and all parameters that are neither."""

    items: list[tuple[str, str | None]] = field(default_factory=list)
    mode: str | None = None
    options: list[str] = field(default_factory=list)  # before the first address
    footer: list[str] = field(default_factory=list)  # behind it
    numbered: bool = False

    @classmethod
    def read(cls, block: str) -> Player:
        out = cls()
        for raw in parameters(block)[1:]:
            text = raw.strip()
            address, title, mode = ADDRESS.fullmatch(text), TITLE.fullmatch(text), MODE.fullmatch(text)
            if address:
                out.items.append((address.group(2), None))
                out.numbered = out.numbered or address.group(1) is not None
            elif title and out.items:
                out.items[-1] = (out.items[-1][0], title.group(2).strip())
            elif mode:
                out.mode = mode.group(1).strip()
            elif not EMPTY.fullmatch(text):  # an empty address is the place of one that was still missing
                (out.footer if out.items else out.options).append(text)
        return out

    def add(self, url: str, title: str | None) -> None:
        """One more address: with a title as the last part of a split recording, without as a mirror in platform order."""
        if url in (u for u, _ in self.items):
            return
        several = bool(self.items)
        self.items.append((url, title))
        if title is not None and several:
            self.mode = "multi"
        elif several and self.mode is None:
            self.mode = "mirrors"
        if title is None:
            self.items.sort(key=lambda item: place(item[0]))  # stable: equal platforms stay as they came

    def write(self) -> str:
        titled = any(title is not None for _, title in self.items)
        numbered = self.numbered or any("=" in url for url, _ in self.items)
        head = "".join("|" + x for x in ([f"mode={self.mode}"] if self.mode else []) + self.options)
        lines = []
        for number, (url, title) in enumerate(self.items, 1):
            shown = title if title is not None else "Complete" if titled else ""
            lines.append(f" |{f'{number}=' if numbered else ''}{url}{f'|t{number}={shown}' if shown else ''}")
        return "\n".join(["{{Player" + head, *lines, *[f" |{x}" for x in self.footer], "}}"])


def place(url: str) -> int:
    """Rank of an address's platform; unknown ones last."""
    return next((i for i, (_, sites) in enumerate(PLAYER_ORDER) if any(s in url.lower() for s in sites)), len(PLAYER_ORDER))


def with_players(text: str, added: list[tuple[str, str | None]]) -> tuple[str, str]:
    """The player block with the addresses added, and the page with it; what is outside of the block stays as it is."""
    span = find_template(text, "Player")
    player = Player.read(text[span[0] : span[1]]) if span else Player()
    for url, title in added:
        player.add(url, title)
    block = player.write()
    return block, text[: span[0]] + block + text[span[1] :] if span else text
