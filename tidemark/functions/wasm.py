"""Byte functions: the integer subset of WebAssembly, interpreted with bounds.

No floats, globals, tables, imports, SIMD or br_table.  A module exports ``memory``
and functions (pointer, length) -> i32; the input is written at 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import WasmError

PAGE, MAX_PAGES, MAX_DEPTH, MAX_ITEMS = 65536, 4096, 256, 1 << 20
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


class _Reader:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def byte(self) -> int:
        if self.at >= self.end:
            raise WasmError("the module is cut off")
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise WasmError("the module is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def u(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return value
            if shift > 63:
                raise WasmError("a number is too long")

    def s(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return value - (1 << shift) if b & 0x40 else value
            if shift > 70:
                raise WasmError("a number is too long")

    def count(self) -> int:
        n = self.u()
        if n > MAX_ITEMS:
            raise WasmError("a vector is too long")
        return n

    def name(self) -> str:
        return self.take(self.u()).decode("utf-8", "replace")


_BLOCKS = {0x02, 0x03, 0x04}
_ONE = {0x0C, 0x0D, 0x10, 0x20, 0x21, 0x22}
_LOADS = {0x28: (4, False, 32), 0x29: (8, False, 64), 0x2C: (1, True, 32), 0x2D: (1, False, 32), 0x2E: (2, True, 32), 0x2F: (2, False, 32), 0x30: (1, True, 64), 0x31: (1, False, 64), 0x32: (2, True, 64), 0x33: (2, False, 64), 0x34: (4, True, 64), 0x35: (4, False, 64)}
_STORES = {0x36: 4, 0x37: 8, 0x3A: 1, 0x3B: 2, 0x3C: 1, 0x3D: 2, 0x3E: 4}


def _decode(r: _Reader) -> list[list]:
    """Instructions [opcode, operand, place of else, place of end]; blocks know where they end."""
    code: list[list] = []
    open_: list[int] = []
    while r.at < r.end:
        op = r.byte()
        arg: object = None
        if op in _BLOCKS:
            kind = r.byte()
            if kind not in (0x40, 0x7F, 0x7E):
                raise WasmError("a block type isn't supported")
            arg = 0 if kind == 0x40 else 1
            open_.append(len(code))
        elif op in _ONE:
            arg = r.u()
        elif op in (0x41, 0x42):
            arg = r.s() & (M32 if op == 0x41 else M64)
        elif op in _LOADS or op in _STORES:
            r.u()
            arg = r.u()
        elif op in (0x3F, 0x40):
            r.byte()
        elif op == 0x05:
            if not open_ or code[open_[-1]][0] != 0x04:
                raise WasmError("else without if")
            code[open_[-1]][2] = len(code)
        elif op == 0x0B:
            if open_:
                at = open_.pop()
                code[at][3] = len(code)
                if code[at][2] is not None:
                    code[code[at][2]][3] = len(code)
        elif not (op in (0x00, 0x01, 0x0F, 0x1A, 0x1B) or 0x45 <= op <= 0x5A or 0x67 <= op <= 0x8A or op in (0xA7, 0xAC, 0xAD, 0xC0, 0xC1, 0xC2, 0xC3, 0xC4)):
            raise WasmError(f"instruction {op:#x} isn't supported")
        code.append([op, arg, None, None])
    if open_:
        raise WasmError("a block has no end")
    return code


class Instance:
    """The interpreter. ``fuel`` bounds the instructions of one call; without it a call may run for any time."""

    def __init__(self, module: bytes, fuel: int | None = None):
        self.fuel = fuel
        if module[:8] != b"\0asm\1\0\0\0":
            raise WasmError("this is not a module")
        self.types, self.funcs, self.exports, self.code = [], [], {}, []
        self.pages, self.most, data = 0, MAX_PAGES, []
        r = _Reader(module, 8)
        while r.at < r.end:
            section, size = r.byte(), r.u()
            body = r.take(size)
            s = _Reader(body)
            if section == 1:
                for _ in range(s.count()):
                    if s.byte() != 0x60:
                        raise WasmError("a type isn't a function")
                    params = [s.byte() for _ in range(s.count())]
                    results = [s.byte() for _ in range(s.count())]
                    if len(results) > 1 or not {*params, *results} <= {0x7F, 0x7E}:
                        raise WasmError("only integers are supported")
                    self.types.append((params, results))
            elif section == 2 and s.count():
                raise WasmError("imports aren't supported")
            elif section == 3:
                self.funcs = [s.u() for _ in range(s.count())]
            elif section == 5:
                for _ in range(s.count()):
                    flag = s.byte()
                    self.pages = s.u()
                    if flag & 1:
                        self.most = min(MAX_PAGES, s.u())
            elif section == 7:
                for _ in range(s.count()):
                    name, kind, index = s.name(), s.byte(), s.u()
                    self.exports[name] = (kind, index)
            elif section == 10:
                for _ in range(s.count()):
                    n = s.u()
                    f = _Reader(s.take(n))
                    local: list[int] = []
                    for _ in range(f.count()):
                        many, kind = f.u(), f.byte()
                        if len(local) + many > 50_000:
                            raise WasmError("too many locals")
                        local += [kind] * many
                    self.code.append((len(local), _decode(f)))
            elif section == 11:
                for _ in range(s.count()):
                    if s.u() or s.byte() != 0x41:
                        raise WasmError("a data segment isn't supported")
                    at = s.s() & M32
                    if s.byte() != 0x0B:
                        raise WasmError("a data segment isn't supported")
                    data.append((at, s.take(s.u())))
            elif section in (4, 6, 9):
                raise WasmError("tables and globals aren't supported")
        if len(self.funcs) != len(self.code) or any(t >= len(self.types) for t in self.funcs):
            raise WasmError("functions and bodies don't match")
        if self.pages > MAX_PAGES:
            raise WasmError("too much memory")
        self.data = data
        self.reset()

    def reset(self) -> None:
        self.memory, self.left = bytearray(self.pages * PAGE), self.fuel
        for at, bytes_ in self.data:
            self._span(at, len(bytes_))
            self.memory[at : at + len(bytes_)] = bytes_

    def _span(self, at: int, n: int) -> None:
        if at + n > len(self.memory):
            raise WasmError("an access lies outside the memory")

    def _start(self, name: str, data: bytes) -> int:
        self.reset()
        if self.exports.get("memory", (0, 0))[0] != 2:
            raise WasmError("the module exports no memory")
        if self.exports.get(name, (1, 0))[0] != 0:
            raise WasmError(f"no such function: {name}")
        need = -(-len(data) // PAGE)
        if need > self.most:
            raise WasmError("the input is larger than the memory may be")
        self.memory.extend(bytes(max(0, need * PAGE - len(self.memory))))
        self.memory[: len(data)] = data
        out = self.call(self.exports[name][1], [0, len(data)])
        if out is None:
            raise WasmError(f"{name} returns nothing")
        return out & M32

    def scalar(self, name: str, data: bytes) -> int:
        out = self._start(name, data)
        return out - (1 << 32) if out >> 31 else out

    def apply(self, name: str, data: bytes) -> bytes:
        n = self._start(name, data)
        self._span(0, n)
        return bytes(self.memory[:n])

    def call(self, index: int, args: list[int], depth: int = 0) -> int | None:
        if depth > MAX_DEPTH:
            raise WasmError("calls are nested too deeply")
        if index >= len(self.code):
            raise WasmError("no such function")
        params, results = self.types[self.funcs[index]]
        n_local, code = self.code[index]
        if len(args) != len(params):
            raise WasmError("wrong number of arguments")
        local, stack = [*args, *[0] * n_local], []
        blocks: list[tuple[int, int, int, int]] = []  # start, end, height, values that leave
        pc, memory = 0, self.memory
        try:
            while pc < len(code):
                if self.left is not None:
                    self.left -= 1
                    if self.left < 0:
                        raise WasmError("the function runs too long")
                op, arg, other, end = code[pc]
                pc += 1
                if op == 0x20:
                    stack.append(local[arg])
                elif op == 0x21:
                    local[arg] = stack.pop()
                elif op == 0x22:
                    local[arg] = stack[-1]
                elif op in (0x41, 0x42):
                    stack.append(arg)
                elif op in (0x02, 0x03):
                    blocks.append((pc - 1 if op == 0x03 else -1, end, len(stack), arg))
                elif op == 0x04:
                    taken = stack.pop()
                    blocks.append((-1, end, len(stack), arg))
                    if not taken:
                        pc = other + 1 if other is not None else end
                elif op == 0x05:
                    pc = end
                elif op == 0x0B:
                    if blocks:
                        blocks.pop()
                elif op in (0x0C, 0x0D, 0x0F):
                    if op == 0x0D and not stack.pop():
                        continue
                    if op == 0x0F or arg == len(blocks):
                        break
                    if arg > len(blocks):
                        raise WasmError("a branch leaves the function")
                    for _ in range(arg):
                        blocks.pop()
                    start, end_, height, leaves = blocks[-1]
                    if start >= 0:
                        del stack[height:]
                        pc = start + 1
                    else:
                        kept = stack[len(stack) - leaves :] if leaves else []
                        del stack[height:]
                        stack += kept
                        pc = end_
                elif op == 0x10:
                    if arg >= len(self.funcs):
                        raise WasmError("no such function")
                    n = len(self.types[self.funcs[arg]][0])
                    given = stack[len(stack) - n :]
                    del stack[len(stack) - n :]
                    if len(given) < n:
                        raise WasmError("the stack is empty")
                    out = self.call(arg, given, depth + 1)
                    if out is not None:
                        stack.append(out)
                elif op == 0x1A:
                    stack.pop()
                elif op == 0x1B:
                    c, b, a = stack.pop(), stack.pop(), stack.pop()
                    stack.append(a if c else b)
                elif op in _LOADS:
                    size, signed, width = _LOADS[op]
                    at = stack.pop() + arg
                    self._span(at, size)
                    stack.append(int.from_bytes(memory[at : at + size], "little", signed=signed) & ((1 << width) - 1))
                elif op in _STORES:
                    size, value = _STORES[op], stack.pop()
                    at = stack.pop() + arg
                    self._span(at, size)
                    memory[at : at + size] = (value & ((1 << 8 * size) - 1)).to_bytes(size, "little")
                elif op == 0x3F:
                    stack.append(len(memory) // PAGE)
                elif op == 0x40:
                    more, have = stack.pop(), len(memory) // PAGE
                    if have + more <= self.most:
                        memory.extend(bytes(more * PAGE))
                        stack.append(have)
                    else:
                        stack.append(M32)
                elif op == 0x00:
                    raise WasmError("unreachable")
                elif op != 0x01:
                    self._number(op, stack)
        except IndexError:
            raise WasmError("the stack is empty or a local unknown") from None
        return stack[-1] if results and stack else None

    @staticmethod
    def _number(op: int, stack: list[int]) -> None:
        if op in (0xA7, 0xAC, 0xAD, 0xC0, 0xC1, 0xC2, 0xC3, 0xC4):
            a = stack.pop()
            bits, to = {0xA7: (0, M32), 0xAC: (32, M64), 0xAD: (0, M64), 0xC0: (8, M32), 0xC1: (16, M32), 0xC2: (8, M64), 0xC3: (16, M64), 0xC4: (32, M64)}[op]
            if bits:
                a &= (1 << bits) - 1
                a = a - (1 << bits) if a >> bits - 1 else a
            stack.append(a & to)
            return
        wide = 0x50 <= op <= 0x5A or op >= 0x79
        bits = 64 if wide else 32
        mask = (1 << bits) - 1
        sign = lambda x: x - (1 << bits) if x >> bits - 1 else x
        if op in (0x45, 0x50):
            stack.append(int(stack.pop() == 0))
            return
        base = op - (0x79 if wide else 0x67) if op >= 0x67 else None
        if base is not None and base < 3:
            a = stack.pop()
            stack.append(bits - a.bit_length() if base == 0 else (bits if a == 0 else (a & -a).bit_length() - 1) if base == 1 else a.bit_count())
            return
        b, a = stack.pop(), stack.pop()
        if base is None:
            k = op - (0x51 if wide else 0x46)
            x, y = (sign(a), sign(b)) if k in (2, 4, 6, 8) else (a, b)
            stack.append(int(x == y if k == 0 else x != y if k == 1 else x < y if k in (2, 3) else x > y if k in (4, 5) else x <= y if k in (6, 7) else x >= y))
            return
        k = base - 3
        if k in (3, 4, 5, 6) and b == 0:
            raise WasmError("division by zero")
        if k == 3 and sign(a) == -(1 << bits - 1) and sign(b) == -1:
            raise WasmError("integer overflow")
        if k in (3, 5):
            x, y = sign(a), sign(b)
            q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
            out = q if k == 3 else x - q * y
        else:
            n = b % bits
            out = (a + b, a - b, a * b, 0, a // b if b else 0, 0, a % b if b else 0, a & b, a | b, a ^ b, a << n, sign(a) >> n, a >> n, a << n | a >> bits - n, a >> n | a << bits - n)[k]
        stack.append(out & mask)


class Backend(Protocol):
    """What runs a module: made of its bytes, once a task."""

    def scalar(self, name: str, data: bytes) -> int: ...

    def apply(self, name: str, data: bytes) -> bytes: ...


def scalar_udf(module: bytes, name: str, backend: Callable[[bytes], Backend] = Instance):
    """A pandas UDF binary -> int; the module is read once a task, not once a row."""
    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = backend(module)
        for s in batches:
            yield s.map(lambda x: None if x is None else own.scalar(name, bytes(x)), na_action=None).astype("Int32")

    return run


def apply_udf(module: bytes, name: str, backend: Callable[[bytes], Backend] = Instance):
    """A pandas UDF binary -> binary."""
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = backend(module)
        for s in batches:
            yield s.map(lambda x: None if x is None else own.apply(name, bytes(x)), na_action=None).astype(object)

    return run


def _leb(n: int) -> bytes:
    out = b""
    while True:
        low, n = n & 0x7F, n >> 7
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def assemble(name: str, n_locals: int, body: bytes, pages: int = 1) -> bytes:
    """A module of one function (i32, i32) -> i32 and a memory, for tests and examples."""
    section = lambda i, b: bytes([i]) + _leb(len(b)) + b
    func = (_leb(1) + _leb(n_locals) + b"\x7f" if n_locals else b"\0") + body + b"\x0b"
    text = name.encode()
    return b"\0asm\1\0\0\0" + section(1, b"\1\x60\2\x7f\x7f\1\x7f") + section(3, b"\1\0") + section(5, b"\1\0" + _leb(pages)) + section(7, b"\2\6memory\2\0" + _leb(len(text)) + text + b"\0\0") + section(10, b"\1" + _leb(len(func)) + func)


def _loop(step: bytes) -> bytes:
    """for local 2 from 0 while less than local 1: step"""
    return b"\x02\x40\x03\x40\x20\2\x20\1\x4f\x0d\1" + step + b"\x20\2\x41\1\x6a\x21\2\x0c\0\x0b\x0b"


#: Sum of the bytes; and each byte plus one, in place.
SUM_BYTES = assemble("sum", 2, _loop(b"\x20\3\x20\0\x20\2\x6a\x2d\0\0\x6a\x21\3") + b"\x20\3")
INC_BYTES = assemble("inc", 1, _loop(b"\x20\0\x20\2\x6a\x20\0\x20\2\x6a\x2d\0\0\x41\1\x6a\x3a\0\0") + b"\x20\1")


def sum_bytes(c: Column) -> Column:
    return scalar_udf(SUM_BYTES, "sum")(c)
