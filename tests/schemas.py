"""Classes that several tests use, and a made-up tram company whose facts come from a seed."""

from __future__ import annotations

import random

from factbase import Key, Unique, entity


@entity
class Depot:
    code: Key[str]
    city: str
    lanes: int


@entity
class Tram:
    plate: Key[str]
    line: int
    depot: Depot
    built: int
    colours: set[str]
    twin: "Tram | None"


@entity
class Trip:
    plate: str
    stop: str
    riders: int


@entity
class Permit:
    name: Key[str]


@entity
class Driver:
    number: Key[int]
    permits: set[Permit]
    home: Depot | None
    nick: str | None


@entity
class Badge:
    number: Key[str]
    holder: Unique[str]


@entity
class Meter:
    name: Key[str]
    n: int


@entity
class Remark:
    text: str


@entity
class Shelf:
    name: Key[str]
    labels: set[str]


@entity
class Stop:
    name: Key[str]
    then: "set[Stop]"


@entity
class Post:
    code: Key[str]
    under: "Post | None"


@entity(key=("a", "b"))
class Rail:
    a: Post
    b: Post


class Fleet:
    """Depots, trams, trips and drivers, and the rows that a plain loop would read."""

    def __init__(self, seed: int):
        rnd = random.Random(seed)
        self.depots = [Depot(f"d{i}", rnd.choice(["Ulm", "Graz", "Lyss"]), rnd.randrange(2, 9)) for i in range(5)]
        self.trams, trams = [], []
        for i in range(24):
            twin = rnd.choice(trams) if trams and rnd.random() < 0.3 else None
            # depot d4 has no tram
            t = Tram(f"t{i:02d}", rnd.randrange(1, 7), rnd.choice(self.depots[:4]), rnd.randrange(1980, 2020), {rnd.choice("rgby") for _ in range(rnd.randrange(3))}, twin)
            trams += [t] if twin is None else []
            self.trams.append(t)
        self.trips = [Trip(rnd.choice([t.plate for t in self.trams] + ["lost"]), f"s{i % 9}", rnd.randrange(1, 80)) for i in range(60)]
        self.trips = list(dict.fromkeys(self.trips))
        permits = [Permit(x) for x in ("snow", "night", "steep")]
        self.drivers = [Driver(i, {p for p in permits if rnd.random() < 0.4}, rnd.choice([None, *self.depots]), rnd.choice([None, "Kim", "Lo"])) for i in range(12)]

    def all(self):
        return [*self.depots, *self.trams, *self.trips, *self.drivers]
