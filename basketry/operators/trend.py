"""Breaks of a trend: candidate hinges, an L1 path over them, and the set that pays for itself.

All of it works on one product's daily series inside a grouped function. Level, trend and waves are
eliminated first, so that the path runs over a Gram matrix of the hinges alone.
"""

import numpy as np

# --- fixed values: candidates for a break of the trend ----------------------------
CANDIDATES, FIRST_SHARE = 25, 0.8

#: Steps of the path, each this share of the penalty before it.
STEPS, SHRINK = 30, 0.79
FREE = 1e-6  # the penalty of a break that was chosen


def hinges(days: np.ndarray, places: np.ndarray, span: float) -> np.ndarray:
    """One column per place: days beyond it, in units of the series' length."""
    return np.maximum(days[:, None] - np.asarray(places, float)[None, :], 0.0) / max(span, 1.0)


def l1_step(gram: np.ndarray, right: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """The d of least d'Gd / 2 - r'd + penalty |d|, by an active set with signs that `start` begins.

    Neighbouring hinges are nearly equal, so moving one coordinate at a time hardly gets on; the active ones are
    solved for together, up to where the first of them changes its sign and leaves.
    """
    d, signs = start.copy(), np.sign(start)
    shut = np.zeros(len(d), bool)  # left at once, by rounding
    while True:
        while signs.any():
            some = np.flatnonzero(signs)
            implied = np.linalg.lstsq(gram[np.ix_(some, some)], right[some] - penalty * signs[some], rcond=None)[0]
            against = implied * signs[some] <= 0
            if not against.any():
                d[some] = implied
                break
            part = np.where(against, d[some] / np.where(against, d[some] - implied, 1.0), np.inf)
            first = int(part.argmin())
            shut[some[first]] |= part[first] == 0
            d[some] += part[first] * (implied - d[some])
            d[some[first]] = signs[some[first]] = 0.0
        slope = np.where((signs != 0) | shut, 0.0, right - gram @ d)
        worst = int(np.abs(slope).argmax())
        if abs(slope[worst]) <= penalty * (1 + 1e-6):
            return d
        signs[worst] = np.sign(slope[worst])


class _Profile:
    """Squared error of a series once the best level, trend and waves are taken out, for any set of breaks."""

    def __init__(self, days: np.ndarray, y: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.days, self.terms, self.span = days, terms, float(days[-1] - days[0])
        self.inverse = np.linalg.inv(terms.T @ terms + np.diag(weights))
        self.rest = self.without(y[:, None])[:, 0]
        self.error = float(y @ self.rest)

    def without(self, columns: np.ndarray) -> np.ndarray:
        return columns - self.terms @ (self.inverse @ (self.terms.T @ columns))

    def moments(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hinges(self.days, places, self.span)
        return h.T @ self.without(h), h.T @ self.rest

    def score(self, gram: np.ndarray, right: np.ndarray) -> float:
        """n log(error / n), and 2 log n for the place and the slope of every break."""
        n = len(self.days)
        gain = right @ np.linalg.solve(gram + FREE * np.eye(len(right)), right) if len(right) else 0.0
        return n * np.log(max(self.error - gain, 1e-12 * self.error) / n) + 2 * len(right) * np.log(n)

    def of(self, places: list[float]) -> float:
        return self.score(*self.moments(np.array(places)))


def _merged(places: np.ndarray, slopes: np.ndarray) -> list[float]:
    """Neighbouring candidates that bend the same way are one break between them."""
    found, run = [], []
    for j in range(len(places) + 1):
        on = j < len(places) and slopes[j] != 0
        if run and not (on and np.sign(slopes[j]) == np.sign(slopes[run[0]])):
            found.append(float(round(np.average(places[run], weights=np.abs(slopes[run])))))
            run = []
        if on:
            run.append(j)
    return found


def breaks(days: np.ndarray, y: np.ndarray, terms: np.ndarray, weights: np.ndarray,
           candidates: int = CANDIDATES, share: float = FIRST_SHARE) -> np.ndarray:
    """Days at which the trend of (days, y) bends, beside `terms` with ridge `weights`; none if one line serves as well.

    Candidates are spread evenly over the first `share` of the series. Of the sets along the path the one of the best
    score is taken; its breaks move by days until the error is least, and go where the score does without them.
    """
    profile = _Profile(days, y, terms, weights)
    if len(days) < 3 or profile.error <= 1e-9 * max(float(y @ y), 1e-300):
        return np.zeros(0)
    places = np.unique(np.round(days[0] + np.linspace(0, share * profile.span, candidates + 1)[1:]))
    gram, right = profile.moments(places)
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    use = scale > 1e-9
    places, scale = places[use], scale[use]
    if not len(places):
        return np.zeros(0)
    gram, right = gram[np.ix_(use, use)] / np.outer(scale, scale), right[use] / scale
    d, tried = np.zeros(len(places)), {(): profile.of([])}
    for step in range(1, STEPS + 1):
        d = l1_step(gram, right, np.abs(right).max() * SHRINK ** step, d)
        chosen = tuple(_merged(places, d / scale))
        if chosen not in tried:
            tried[chosen] = profile.of(list(chosen))
    best = list(min(tried, key=lambda x: (tried[x], len(x))))
    return np.array(sorted(_settled(profile, best, share, (places[-1] - places[0]) / max(len(places) - 1, 1))))


def _settled(profile: _Profile, found: list[float], share: float, spacing: float) -> list[float]:
    last = profile.days[0] + share * profile.span
    reach = int(np.ceil(spacing))
    while found:
        for _ in range(3):
            before = list(found)
            for k, place in enumerate(before):
                others = [p for i, p in enumerate(found) if i != k]
                near = np.arange(max(place - reach, profile.days[0] + 1), min(place + reach, last) + 1)
                near = np.array([p for p in near if p not in others] or [place])
                gram, right = profile.moments(np.concatenate([near, others]))
                rest = list(range(len(near), len(near) + len(others)))
                scores = [profile.score(gram[np.ix_([i, *rest], [i, *rest])], right[[i, *rest]]) for i in range(len(near))]
                found[k] = float(near[int(np.argmin(scores))])
            if found == before:
                break
        less = [profile.of(found[:k] + found[k + 1:]) for k in range(len(found))]
        if min(less) > profile.of(found):
            break
        found.pop(int(np.argmin(less)))
    return found
