"""The gate catalogue: names, controls, arities, and the matrices of the simulator."""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number of control qubits by gate name; 0 where absent.
NUM_CTRL = {"cx": 1, "cnot": 1, "cy": 1, "cz": 1, "ch": 1, "cp": 1, "crx": 1, "cry": 1, "crz": 1, "cs": 1, "csdg": 1, "csx": 1, "cu": 1, "cu1": 1, "cu3": 1, "cswap": 1, "ccx": 2, "toffoli": 2, "ccz": 2, "rccx": 0, "c3x": 3, "c4x": 4, "c3sqrtx": 3}
#: Ops that measure or reset, that are not ops on a state, and that count as entangling in a circuit's figures.
MEASURES = ("measure", "reset")
PASSIVE = ("barrier", "delay")
TWO_QUBIT_COUNTED = ("cx", "cnot", "cz", "ecr", "rzz")
#: The same where a corpus is loaded.
TWO_QUBIT_LOADED = ("cx", "cnot", "cz", "ecr")
#: Gates that the lenient reader keeps.
LENIENT = ("id", "x", "y", "z", "h", "s", "sdg", "t", "tdg", "rx", "ry", "rz", "p", "u1", "u2", "u3", "u", "cx", "cnot", "cz", "cy", "ch", "swap", "ccx", "toffoli")


def touches(gate: str) -> Column:
    return ~F.col(gate).isin(*PASSIVE)


def _u(theta: float, phi: float, lam: float) -> np.ndarray:
    c, s = math.cos(theta / 2), math.sin(theta / 2)
    return np.array([[c, -cmath.exp(1j * lam) * s], [cmath.exp(1j * phi) * s, cmath.exp(1j * (phi + lam)) * c]])


def _diag(*values: complex) -> np.ndarray:
    return np.diag(np.array(values, dtype=complex))


_X = np.array([[0, 1], [1, 0]], dtype=complex)
_Y = np.array([[0, -1j], [1j, 0]])
_H = np.array([[1, 1], [1, -1]], dtype=complex) / math.sqrt(2)
_SX = np.array([[1 + 1j, 1 - 1j], [1 - 1j, 1 + 1j]]) / 2
_SWAP = np.array([[1, 0, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1]], dtype=complex)
_ISWAP = np.array([[1, 0, 0, 0], [0, 0, 1j, 0], [0, 1j, 0, 0], [0, 0, 0, 1]])

_PLAIN = {
    "id": lambda: np.eye(2, dtype=complex), "x": lambda: _X, "y": lambda: _Y, "z": lambda: _diag(1, -1), "h": lambda: _H,
    "s": lambda: _diag(1, 1j), "sdg": lambda: _diag(1, -1j), "t": lambda: _diag(1, cmath.exp(1j * math.pi / 4)), "tdg": lambda: _diag(1, cmath.exp(-1j * math.pi / 4)),
    "sx": lambda: _SX, "sxdg": lambda: _SX.conj().T, "swap": lambda: _SWAP, "iswap": lambda: _ISWAP,
    "rz": lambda a: _diag(cmath.exp(-0.5j * a), cmath.exp(0.5j * a)), "p": lambda a: _diag(1, cmath.exp(1j * a)), "u1": lambda a: _diag(1, cmath.exp(1j * a)),
    "rx": lambda a: _u(a, -math.pi / 2, math.pi / 2), "ry": lambda a: _u(a, 0, 0), "u2": lambda a, b: _u(math.pi / 2, a, b), "u3": _u, "u": _u,
    "rzz": lambda a: _diag(cmath.exp(-0.5j * a), cmath.exp(0.5j * a), cmath.exp(0.5j * a), cmath.exp(-0.5j * a)),
    "rxx": lambda a: math.cos(a / 2) * np.eye(4) - 1j * math.sin(a / 2) * np.kron(_X, _X),
    "ryy": lambda a: math.cos(a / 2) * np.eye(4) - 1j * math.sin(a / 2) * np.kron(_Y, _Y),
}
#: Controlled forms: the gate under control and how many controls come first.
_CONTROLLED = {"cx": ("x", 1), "cnot": ("x", 1), "cy": ("y", 1), "cz": ("z", 1), "ch": ("h", 1), "cp": ("p", 1), "cu1": ("u1", 1), "cu3": ("u3", 1), "crx": ("rx", 1), "cry": ("ry", 1), "crz": ("rz", 1), "csx": ("sx", 1), "cs": ("s", 1), "csdg": ("sdg", 1), "cswap": ("swap", 1), "ccx": ("x", 2), "toffoli": ("x", 2), "ccz": ("z", 2), "c3x": ("x", 3), "c4x": ("x", 4)}


class UnknownGate(ValueError):
    """A gate whose matrix is not known; never taken for the identity."""


def matrix(name: str, params: tuple[float, ...] = ()) -> np.ndarray:
    """Matrix of a gate, little-endian: bit j of a row or column is the j-th qubit of the op."""
    if name in _CONTROLLED:
        inner, n = _CONTROLLED[name]
        m = matrix(inner, params)
        size = len(m) << n
        out = np.eye(size, dtype=complex)
        on = [(k << n) | ((1 << n) - 1) for k in range(len(m))]
        out[np.ix_(on, on)] = m
        return out
    if name not in _PLAIN:
        raise UnknownGate(name)
    return np.asarray(_PLAIN[name](*params), dtype=complex)


def num_ctrl(gate: Column) -> Column:
    out = F.lit(0)
    for n in sorted(set(NUM_CTRL.values()) - {0}):
        out = F.when(gate.isin(*[g for g, k in NUM_CTRL.items() if k == n]), n).otherwise(out)
    return out
