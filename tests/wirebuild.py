"""Writes wire values and interface entries for tests."""

import base64
import struct


def u32(n):
    return struct.pack(">I", n)


def opaque(raw):
    raw = raw.encode() if isinstance(raw, str) else raw
    return u32(len(raw)) + raw + b"\0" * (-len(raw) % 4)


def symbol(text):
    return u32(15) + opaque(text)


def i128(n):
    return u32(10) + (n % (1 << 128)).to_bytes(16, "big")


def vec(*items):
    return u32(16) + u32(1) + u32(len(items)) + b"".join(items)


def mapping(*pairs):
    return u32(17) + u32(1) + u32(len(pairs)) + b"".join(k + v for k, v in pairs)


def account(seed):
    return u32(18) + u32(0) + u32(0) + bytes([seed]) * 32


def contract(seed):
    return u32(18) + u32(1) + bytes([seed]) * 32


def b64(raw):
    return base64.b64encode(raw).decode()


PLAIN = {"Val": 0, "bool": 1, "void": 2, "u32": 4, "u64": 6, "i128": 11, "u128": 10, "String": 16, "Symbol": 17, "Address": 19}


def type_(t):
    """'i128', ('udt', name), ('opt', t), ('vec', t), ('map', k, v), ('tup', t...), ('bytes', n), ('res', a, b)."""
    if isinstance(t, str):
        return u32(PLAIN[t])
    kind, *args = t
    if kind == "udt":
        return u32(2000) + opaque(args[0])
    if kind == "bytes":
        return u32(1006) + u32(args[0])
    if kind == "tup":
        return u32(1005) + u32(len(args)) + b"".join(map(type_, args))
    return u32({"opt": 1000, "res": 1001, "vec": 1002, "map": 1004}[kind]) + b"".join(map(type_, args))


def many(items):
    return u32(len(items)) + b"".join(items)


def field(name, t):
    return opaque("") + opaque(name) + type_(t)


def function(name, inputs=(), output=None, doc=""):
    outputs = [] if output is None else [type_(output)]
    return u32(0) + opaque(doc) + opaque(name) + many([field(*i) for i in inputs]) + many(outputs)


def struct_(name, fields):
    return u32(1) + opaque("") * 2 + opaque(name) + many([field(*f) for f in fields])


def union(name, cases):
    out = []
    for case, types in cases:
        body = opaque("") + opaque(case)
        out.append(u32(1) + body + many([type_(t) for t in types]) if types else u32(0) + body)
    return u32(2) + opaque("") * 2 + opaque(name) + many(out)


def enum(name, cases, tag=3):
    return u32(tag) + opaque("") * 2 + opaque(name) + many([opaque("") + opaque(n) + u32(v) for n, v in cases])


def event(name, params=(), prefix=None, layout="single"):
    """params: (name, type, 'topic' or 'data')."""
    prefix = [name] if prefix is None else prefix
    written = [field(n, t) + u32({"data": 0, "topic": 1}[where]) for n, t, where in params]
    return (
        u32(5) + opaque("") * 2 + opaque(name) + many([opaque(p) for p in prefix]) + many(written)
        + u32({"single": 0, "vec": 1, "map": 2}[layout])
    )


def leb(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def module(section, name=b"contractspecv0"):
    body = leb(len(name)) + name + section
    return b"\0asm\1\0\0\0" + b"\0" + leb(len(body)) + body


TRANSFER_MODULE = module(event("transfer", [("from", "Address", "topic"), ("amount", "i128", "data")]))
