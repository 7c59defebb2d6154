"""Services of one's own: an entity is a key, routes, and a transition function for each.

A registered entity runs in the same job as the built-in ones: records are
parsed, keyed and matched to its routes, its functions decide outcomes on the
key's state, and the outcomes become replies or messages to other topics.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from tillflow import vocabulary as v
from tillflow.streaming import jobs, rules
from tillflow.streaming.processors import Keyed

# (state, message) -> (state, outcomes); a state is anything JSON can hold or None,
# an outcome is (name, extra params, text or None)
Step = Callable[[object, object], tuple[object, list[tuple[str, dict, str | None]]]]


@dataclass(frozen=True)
class Reply:
    """What an outcome of a route is answered with.

    ``kind`` is success, failure, error, or redirect, which sends the message on
    to the ``topic``, ``route`` and state ``token``.
    """

    route: str
    outcome: str
    kind: str
    text: str | None = None
    topic: str | None = None
    to_route: str = rules.SAME
    token: str | None = None
    params: str = rules.EXTRA


@dataclass(frozen=True)
class Entity:
    """A service: its name, the parameter that keys it, and its steps by route.

    The outcomes ``absent`` (no such entry), ``refused`` (the text comes with
    it) and unknown routes have replies already.
    """

    name: str
    key_param: str
    steps: dict[str, Step]
    replies: list[Reply] = field(default_factory=list)
    topic: str | None = None


class StepProcessor(Keyed):
    """Keeps an entity's state as JSON text and applies its steps."""

    def __init__(self, steps: dict[str, Step]):
        self.steps = steps

    def load(self, key, state):
        self.state = state

    def apply(self, key, m):
        # a step may change what it is given, so a failing one leaves a copy behind
        self.state, outcomes = self.steps[m.rule](json.loads(json.dumps(self.state)), m)
        return outcomes

    def store(self, key):
        return self.state


def register(entity: Entity) -> None:
    """Make the entity known to ``jobs.service_job``; registering a name again replaces it."""
    if entity.name in v.IN_TOPIC:
        raise ValueError(f"{entity.name} is a built-in service")
    name = entity.name
    rules.RULES[:] = [r for r in rules.RULES if r[0] != name] + [(name, route, rules.ANY, rules.ANY) for route in entity.steps]
    fixed = [("absent", "error", v.not_found(name)), ("refused", "error", None), ("unknown_route", "error", v.UNKNOWN_ROUTE)]
    rules.MORE_REPLIES[:] = [r for r in rules.MORE_REPLIES if r[0] != name] + [
        (name, rules.ANY, outcome, kind, text, None, rules.SAME, None, rules.EXTRA) for outcome, kind, text in fixed] + [
        (name, r.route, r.outcome, r.kind, r.text, r.topic, r.to_route, r.token, r.params) for r in entity.replies]
    jobs.KEY_PARAM[name] = entity.key_param
    steps = entity.steps
    jobs.PROCESSORS[name] = lambda: StepProcessor(steps)
