"""Minimising a smooth loss on the driver, for models fitted on bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def descend(target: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, settled: float, memory: int = 8) -> np.ndarray:
    """A minimum by limited-memory quasi-Newton steps; every step lowers the loss, the last five by less than ``settled``."""
    loss, slope = target(at)
    losses, moves, turns = [loss], [], []
    while len(losses) <= 5 or losses[-6] - losses[-1] > settled * losses[-6]:
        way, shares = slope.copy(), []
        for move, turn in zip(reversed(moves), reversed(turns), strict=True):
            shares.append(move @ way / (move @ turn))
            way -= shares[-1] * turn
        way *= moves[-1] @ turns[-1] / (turns[-1] @ turns[-1]) if moves else 1 / max(1.0, float(np.linalg.norm(slope)))
        for move, turn, share in zip(moves, turns, reversed(shares), strict=True):
            way += (share - turn @ way / (move @ turn)) * move
        fall, size = slope @ way, 1.0
        while size > 1e-10 and not (found := target(at - size * way))[0] <= loss - 1e-4 * size * fall:
            size /= 2
        if size <= 1e-10:  # no lower point in this direction: the bottom, as far as numbers tell
            break
        move, turn = -size * way, found[1] - slope
        at, (loss, slope) = at + move, found
        losses.append(loss)
        if move @ turn > 1e-12:
            moves, turns = [*moves[1 - memory :], move], [*turns[1 - memory :], turn]
    return at
