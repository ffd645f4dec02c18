"""Control flow: conditions and loops whose bodies are lazy and whose state is written each turn."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from ..session import dropped
from ..types import BOOL
from .expression import Expression, wrap
from .tensor import Tensor

State = dict[str, Any]


def truth(condition: object) -> bool:
    """A bool scalar's value."""
    if isinstance(condition, bool):
        return condition
    e = wrap(condition)
    if e.dtype != BOOL or e.shape.elements != 1:
        raise TypeError("a condition must be a bool scalar")
    return bool((e if isinstance(e, Tensor) else e.lazy()).scalar())


def if_(condition: object, then: Callable[[], Any], otherwise: Callable[[], Any] | None = None) -> Any:
    if truth(condition):
        return then()
    return otherwise() if otherwise else None


def _settled(state: State) -> State:
    return {k: v.materialize() if isinstance(v, Expression) else v for k, v in state.items()}


def while_(condition: Callable[[State], object], body: Callable[[State], State], state: State) -> State:
    """Repeat while the condition holds; each turn's tensors are written, so plans do not grow."""
    while truth(condition(state)):
        new = _settled(body(state))
        dropped(*(v.df for k, v in state.items() if isinstance(v, Tensor) and new.get(k) is not v and not any(v is x for x in new.values())))
        state = new
    return state


def repeat(times: int, body: Callable[[State], State], state: State) -> State:
    turns = iter(range(times))
    return while_(lambda _: next(turns, None) is not None, body, state)


def timed(body: Callable[[], Any]) -> tuple[Any, int]:
    """A body's result and its nanoseconds; a lazy tensor is computed inside the time."""
    begin = time.perf_counter_ns()
    out = body()
    if isinstance(out, Expression):
        out = out.materialize()
    return out, time.perf_counter_ns() - begin


def in_parallel(*bodies: Callable[[], Any]) -> list[Any]:
    """Independent jobs at once."""
    with ThreadPoolExecutor(len(bodies)) as pool:
        return [f.result() for f in [pool.submit(b) for b in bodies]]
