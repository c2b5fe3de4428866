"""Random forests that R has saved: a reader of its serialization (XDR, version 2 or 3) and the trees in it."""

from __future__ import annotations

import gzip
import struct
from typing import Any

import numpy as np

from quillframe.ml.forest import Forest, Tree


class RObject(dict):
    """A value with attributes: value under "", attributes under their names."""

    @property
    def value(self) -> Any:
        return self[""]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.refs = data, 0, []

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def int(self) -> int:
        return self.take(">i")[0]

    def length(self) -> int:
        n = self.int()
        return n if n >= 0 else (self.int() << 32) + self.int()

    def array(self, kind: str) -> np.ndarray:
        n = self.length()
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def item(self) -> Any:
        flags = self.int()
        kind, has_attr, has_tag = flags & 255, bool(flags & 0x200), bool(flags & 0x400)
        if kind in (254, 242, 253, 252, 251, 250, 249, 241):
            return None
        if kind == 255:
            return self.refs[(flags >> 8 or self.int()) - 1]
        if kind == 1:
            name = self.item()
            self.refs.append(name)
            return name
        if kind == 4:
            self.int()
            env = RObject({"": None})
            self.refs.append(env)
            for _ in range(4):
                self.item()
            return env
        if kind in (2, 6, 5, 3):
            return self.pairs(has_attr, has_tag)
        if kind == 9:
            n = self.int()
            text = None if n < 0 else self.data[self.at : self.at + n].decode("utf-8", "replace")
            self.at += max(0, n)
            return text
        if kind in (10, 13):
            value: Any = self.array(">i4")
        elif kind == 14:
            value = self.array(">f8")
        elif kind == 15:
            n = self.length()
            value = np.frombuffer(self.data, ">c16", n, self.at)
            self.at += value.nbytes
        elif kind in (16, 19, 20):
            value = [self.item() for _ in range(self.length())]
        elif kind == 24:
            value = self.array("u1").tobytes()
        elif kind in (7, 8):
            value = self.data[self.at + 4 : self.at + 4 + struct.unpack_from(">i", self.data, self.at)[0]].decode()
            self.at += 4 + len(value)
        elif kind == 238:
            value = [self.item() for _ in range(3)][1]
            return value
        else:
            raise ValueError(f"R type {kind} isn't read")
        out = RObject({"": value})
        if has_attr:
            out.update(self.item() or {})
        if isinstance(value, list) and isinstance(names := out.get("names"), RObject):
            out["fields"] = dict(zip(names.value, value, strict=False))
        return out

    def pairs(self, has_attr: bool, has_tag: bool) -> dict:
        """A pairlist as a dict; entries without a tag have their place as key."""
        out: dict = {}
        while True:
            if has_attr:
                self.item()
            tag = self.item() if has_tag else len(out)
            out[tag] = self.item()
            flags = struct.unpack_from(">i", self.data, self.at)[0]
            if flags & 255 not in (2, 6):
                rest = self.item()
                if rest is not None:
                    out["..."] = rest
                return out
            self.at += 4
            has_attr, has_tag = bool(flags & 0x200), bool(flags & 0x400)


def read_r(data: bytes) -> Any:
    """An R object out of a file's bytes, zipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    data = data.removeprefix(b"RDX2\n").removeprefix(b"RDX3\n")
    if data[:2] != b"X\n":
        raise ValueError("not R's XDR form")
    r = _Reader(data)
    r.at = 2
    version, _, _ = r.int(), r.int(), r.int()
    if version == 3:
        r.at += r.int()
    return r.item()


def forest(data: bytes) -> Forest:
    """The forest of a saved randomForest object of kind classification."""
    top = read_r(data)
    if isinstance(top, dict) and not isinstance(top, RObject):
        top = next(v for v in top.values() if isinstance(v, RObject) and "forest" in v.get("fields", {}))
    whole = top["fields"]
    f = whole["forest"]["fields"]
    classes = list(whole["classes"].value)
    ntree, nodes = int(f["ntree"].value[0]), int(f["nrnodes"].value[0])
    names = list(f["xlevels"]["names"].value)
    maps = np.asarray(f["treemap"].value).reshape(ntree, 2, nodes)
    status, best, pred, split = (np.asarray(f[k].value).reshape(ntree, nodes) for k in ("nodestatus", "bestvar", "nodepred", "xbestsplit"))
    size = np.asarray(f["ndbigtree"].value)
    trees = []
    for t in range(ntree):
        n = int(size[t])
        inner = status[t, :n] == 1
        trees.append(Tree(
            np.where(inner, best[t, :n] - 1, -1).tolist(), split[t, :n].astype(float).tolist(), np.where(inner, maps[t, 0, :n] - 1, -1).tolist(),
            np.where(inner, maps[t, 1, :n] - 1, -1).tolist(), np.maximum(pred[t, :n] - 1, 0).tolist(),
        ))
    return Forest(names, str(whole.get("response", "class")) if isinstance(whole.get("response"), str) else "class", classes, trees)
