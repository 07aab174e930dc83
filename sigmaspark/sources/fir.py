"""FIR coefficient files: text (comments with name and decimation, one number a line) or binary."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from .files import Bytes, put

MAGIC, VERSION = b"DFIR", 1


@dataclass
class Fir:
    coef: list[float] = field(default_factory=list)
    decimation: int = 8
    name: str = ""


def load(path: str) -> Fir:
    with Bytes(path) as f:
        raw = f.at(0, f.size)
    if raw[:4] == MAGIC:
        version, count, decimation, name_len = struct.unpack_from("<IIII", raw, 4)
        if version != VERSION:
            raise ValueError(f"version {version} of coefficient files is not supported")
        name = raw[20 : 20 + name_len].decode("utf-8", "replace")
        return Fir(list(struct.unpack_from(f"<{count}d", raw, 20 + name_len)), decimation, name)
    out = Fir()
    for line in raw.decode("utf-8", "replace").splitlines():
        line = line.strip()
        if m := re.match(r"#\s*(Name|Decimation)\s*:\s*(.*)", line, re.I):
            if m[1].lower() == "name":
                out.name = m[2].strip()
            else:
                out.decimation = int(m[2])
        elif line and not line.startswith("#"):
            out.coef.append(float(line))
    if not out.coef:
        raise ValueError("no coefficients")
    return out


def save(fir: Fir, path: str, binary: bool = False) -> None:
    name = fir.name.encode()
    if binary:
        put(path, [MAGIC + struct.pack("<IIII", VERSION, len(fir.coef), fir.decimation, len(name)) + name + struct.pack(f"<{len(fir.coef)}d", *fir.coef)])
    else:
        put(path, ["\n".join([f"# Name: {fir.name}", f"# Decimation: {fir.decimation}", *(repr(float(c)) for c in fir.coef), ""]).encode()])
