"""Fax coding of bilevel images: one- and two-dimensional Group 3 and Group 4, decoded row by row against a reference line.

A row is a list of changing places, at which its colour turns, starting from white; the
line before is the reference. Run lengths are prefix codes; a two-dimensional row says
how far each change is from one of the line above.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np

#: Fixed values (ITU-T T.4): codes of white runs of 0 to 63, then of 64 to 1728 in steps of 64.
WHITE = """
00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011
""".split()
#: Fixed values (ITU-T T.4): codes of black runs of 0 to 63, then of 64 to 1728 in steps of 64.
BLACK = """
0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
""".split()
#: Fixed values (ITU-T T.4): codes of runs of 1792 to 2560 in steps of 64, of either colour.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Fixed values (ITU-T T.4, T.6): the pass and horizontal modes, vertical ones by their distance, the end of a line.
PASS, HORIZONTAL, END = "0001", "001", "000000000001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
#: Pixels of an image: beyond this its parameters are not believed.
MOST = 1 << 30


class FaxError(ValueError):
    """Bits that are no fax image."""


def _runs(short: list[str]) -> dict[str, int]:
    lengths = [*range(64), *range(64, 1729, 64)]
    return dict(zip(short, lengths)) | {code: 1792 + 64 * k for k, code in enumerate(LONG)}


CODES = (_runs(WHITE), _runs(BLACK))
MODES = {PASS: "pass", HORIZONTAL: "horizontal", **{code: d for d, code in VERTICAL.items()}}


@lru_cache(maxsize=4)
def _lookup(kind: int) -> list:
    """(meaning, bits) by the next 13 bits, for white (0) and black (1) runs and for modes (2)."""
    table: list = [None] * (1 << 13)
    for code, meaning in (MODES if kind == 2 else CODES[kind]).items():
        first = int(code, 2) << (13 - len(code))
        for k in range(1 << (13 - len(code))):
            table[first + k] = (meaning, len(code))
    return table


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\0\0\0", 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte, bit = self.at >> 3, self.at & 7
        return int.from_bytes(self.data[byte : byte + 4].ljust(4, b"\0"), "big") >> (32 - bit - n) & ((1 << n) - 1)

    def take(self, kind: int):
        found = _lookup(kind)[self.peek(13)]
        if found is None or self.at + found[1] > self.size:
            raise FaxError("no such code")
        self.at += found[1]
        return found[0]

    def run(self, color: int) -> int:
        total = 0
        while True:
            part = self.take(color)
            total += part
            if total > MOST:
                raise FaxError("a run beyond any line")
            if part < 64:
                return total

    def line_end(self) -> bool:
        """Skips an end of line, with the zeros that may fill up before it."""
        at = self.at
        while self.at < self.size and self.peek(11) == 0 and self.peek(12) == 0:
            self.at += 1
        if self.at + 12 <= self.size and self.peek(12) == 1:
            self.at += 12
            return True
        self.at = at
        return False


def _flat(bits: _Bits, columns: int) -> list[int]:
    """Changing places of a row of runs."""
    out, at, color = [], 0, 0
    while at < columns:
        at += bits.run(color)
        out.append(min(at, columns))
        color ^= 1
    return out


def _against(bits: _Bits, columns: int, above: list[int]) -> list[int]:
    """Changing places of a row that is told from the one above."""
    out, at, color, k = [], -1, 0, 0
    above = [*above, columns, columns, columns]
    while at < columns:
        k = max(0, k - 2)
        while k < len(above) - 3 and (above[k] <= at or k % 2 != color):  # the first change to the other colour to the right
            k += 1
        if k % 2 != color:
            k += 1
        b1, b2 = above[min(k, len(above) - 1)], above[min(k + 1, len(above) - 1)]
        mode = bits.take(2)
        if mode == "pass":
            at = b2
        elif mode == "horizontal":
            first = max(at, 0) + bits.run(color)
            second = first + bits.run(color ^ 1)
            out += [min(first, columns), min(second, columns)]
            at = second
        else:
            to = b1 + mode
            if to < max(at, 0) or to > columns or (to == at and at > 0 and out and out[-1] > to):
                raise FaxError("a change to the left of the last")
            out.append(to)
            at, color = to, color ^ 1
            if to >= columns:
                break
    return out


def _painted(changes: list[int], columns: int) -> np.ndarray:
    """A row's pixels, 1 for black."""
    turns = np.zeros(columns + 1, np.int64)
    np.add.at(turns, np.minimum(np.array(changes, np.int64), columns), 1)
    return (np.cumsum(turns[:columns]) % 2).astype(np.uint8)


def decode(data: bytes, k: int = 0, columns: int = 1728, rows: int = 0, black_is_1: bool = False, byte_align: bool = False) -> bytes:
    """The rows of an image, each in whole bytes: ``k`` below 0 is Group 4, 0 one-dimensional and above 0 mixed Group 3.

    With ``rows`` 0 all that is there is read. Ends of lines may be there or not. An image
    that ends early or has a bad row keeps the rows before it, the rest of a known number
    is white; bad bits in the first row raise.
    """
    if not 0 < columns <= MOST or rows < 0 or columns * max(rows, 1) > MOST:
        raise FaxError("an image of this size is not believed")
    bits, out, above = _Bits(data), [], []
    while (len(out) < rows if rows else True) and bits.at < bits.size:
        if byte_align:
            bits.at = (bits.at + 7) // 8 * 8
        ends = 0
        flat = k == 0
        while ends < 6 and bits.line_end():
            ends += 1
            if k > 0:
                flat = bits.peek(1) == 1
                bits.at += 1
        if ends >= 2:  # two in a row end a Group 4 image, more a Group 3 one
            break
        if k > 0 and not ends:  # without marks the first of every k rows stands on its own
            flat = not out
        if bits.at >= bits.size:
            break
        try:
            above = _flat(bits, columns) if flat else _against(bits, columns, above)
        except FaxError:
            if not out:
                raise
            break
        out.append(np.packbits(_painted(above, columns)))
        if len(out) * columns > MOST:
            raise FaxError("an image of this size is not believed")
    out += [np.zeros((columns + 7) // 8, np.uint8)] * (rows - len(out))
    body = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return (body if black_is_1 else ~body).tobytes()


TOLD = tuple({length: code for code, length in codes.items()} for codes in CODES)


def _told(n: int, color: int) -> str:
    codes = TOLD[color]
    out = ""
    while n >= 2560 + 64:
        out, n = out + codes[2560], n - 2560
    if n >= 64:
        out, n = out + codes[n // 64 * 64], n % 64
    return out + codes[n]


def _changes(row: np.ndarray) -> list[int]:
    turned = np.flatnonzero(np.diff(np.concatenate([[0], row])))
    return [int(x) for x in turned]


def _next(changes: list[int], at: int, columns: int, color: int | None = None) -> int:
    """The first change behind ``at``, of those that end ``color`` if it is given; the row's end without any."""
    k = bisect_right(changes, at)
    if color is not None and k % 2 != color:
        k += 1
    return changes[k] if k < len(changes) else columns


def encode(data: bytes, k: int = 0, columns: int = 1728, black_is_1: bool = False, ends: bool = False) -> bytes:
    """Fax codes of whole rows of pixels; ``ends`` puts marks of line ends before rows of Group 3 (mixed coding always has them)."""
    pixels = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, (columns + 7) // 8), axis=1)[:, :columns]
    if not black_is_1:
        pixels = 1 - pixels
    out, above = [], []
    for n, row in enumerate(pixels):
        own = _changes(row)
        flat = k == 0 or (k > 0 and n % k == 0)
        if k > 0:
            out.append(END + ("1" if flat else "0"))
        elif k == 0 and ends:
            out.append(END)
        if flat:
            edges = [0, *own, columns]
            out += [_told(b - a, j % 2) for j, (a, b) in enumerate(zip(edges, edges[1:]))]
        else:
            at, color = -1, 0
            while at < columns:
                b1 = _next(above, at, columns, color)
                b2 = _next(above, b1, columns)
                a1 = _next(own, at, columns, color)
                if b2 < a1:
                    out.append(PASS)
                    at = b2
                elif abs(a1 - b1) <= 3:
                    out.append(VERTICAL[a1 - b1])
                    at, color = a1, color ^ 1
                else:
                    a2 = _next(own, a1, columns)
                    out.append(HORIZONTAL + _told(a1 - max(at, 0), color) + _told(a2 - a1, color ^ 1))
                    at = a2
        above = own
    if k < 0:
        out.append(END * 2)
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
