"""A deficit round-robin schedule over source queues, in closed form.

Windows of `width` tokens are cut from one long tape. In each window every lane (a source, or the
pool of sources too small for a token a window) may take its share; what rounding gives or withholds
is carried to the next window, so after any number of windows a lane has had its share to within one
token. Because the carry has a closed form, a partition can start anywhere on the tape and knows
the deficits of all windows before it.

With weights, a lane whose queue runs dry leaves the round; the others go on in the proportions of
their weights. Each such phase is one stretch of the tape.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

#: A lane needs two tokens of a full window, else rounding could take back what it gave.
LEAST_TOKENS = 2


@dataclass
class Schedule:
    width: int
    totals: list[int]  # tokens in each lane's queue
    starts: list[int]  # where each phase begins on the tape; the last entry is its end
    served: list[list[int]]  # per phase: tokens each lane had had before it; one more row for the end
    bounds: list[list[int]]  # per phase: running sums over lanes of what they have in it

    @classmethod
    def make(cls, totals: list[int], weights: list[Fraction] | None, width: int) -> Schedule:
        """weights=None: in proportion to the totals, so that all queues run dry together."""
        n = len(totals)
        weights = [Fraction(t) for t in totals] if weights is None else [Fraction(w) for w in weights]
        dry = sorted({Fraction(t) / w for t, w in zip(totals, weights, strict=True) if t and w > 0})
        served = [[0] * n]
        for moment in dry:
            served.append([min(t, int(w * moment)) for t, w in zip(totals, weights, strict=True)])
        if served[-1] != list(totals):  # what has no weight follows at the end
            served.append(list(totals))
        served = cls._without_slivers(served, width)
        starts, bounds = [0], []
        for before, after in zip(served, served[1:], strict=False):
            run, at = [0], 0
            for a, b in zip(before, after, strict=True):
                at += b - a
                run.append(at)
            bounds.append(run)
            starts.append(starts[-1] + at)
        return cls(width, list(totals), starts, served, bounds)

    @staticmethod
    def _without_slivers(served: list[list[int]], width: int) -> list[list[int]]:
        """Lanes with less than LEAST_TOKENS of a window follow the others of their phase, each as a phase of its own."""
        out = served[:1]
        for before, after in zip(served, served[1:], strict=False):
            share = [b - a for a, b in zip(before, after, strict=True)]
            total = sum(share)
            slivers = [i for i, x in enumerate(share) if 0 < x * width < LEAST_TOKENS * total]
            row = list(after)
            for i in slivers:
                row[i] = before[i]
            if row != out[-1]:
                out.append(row)
            for i in slivers:
                row = list(row)
                row[i] = after[i]
                out.append(row)
        return out

    def _had(self, phase: int, lane: int, filled: int) -> int:
        """Tokens of `lane` among the first `filled` of a phase."""
        run = self.bounds[phase]
        total = run[-1]
        return filled * run[lane + 1] // total - filled * run[lane] // total

    def pieces(self, lane: int, position: int, length: int):
        """Yields (start in the queue, length, place on the tape) for a run of a lane's queue, cut at windows and phases."""
        end = position + length
        while position < end:
            # The phase that serves this position: the last whose beginning is not after it, and that serves the lane at all.
            lo, hi = 0, len(self.bounds) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if self.served[mid + 1][lane] > position:
                    hi = mid
                else:
                    lo = mid + 1
            phase = lo
            inner = position - self.served[phase][lane]
            begin, total = self.starts[phase], self.bounds[phase][-1]
            first = begin // self.width
            last = (begin + total - 1) // self.width
            lo, hi = first, last
            while lo < hi:  # the first window after which the lane has had more than `inner`
                mid = (lo + hi) // 2
                if self._had(phase, lane, min(total, (mid + 1) * self.width - begin)) > inner:
                    hi = mid
                else:
                    lo = mid + 1
            window = lo
            stop = self.served[phase + 1][lane] - self.served[phase][lane]
            while position < end and inner < stop:
                at = max(0, window * self.width - begin)
                upto = min(total, (window + 1) * self.width - begin)
                had, will = self._had(phase, lane, at), self._had(phase, lane, upto)
                if will <= inner:
                    window += 1
                    continue
                take = min(end - position, will - inner)
                # In a window lanes stand one after the other.
                run = self.bounds[phase]
                ahead = (upto * run[lane] // total) - (at * run[lane] // total)
                yield position, take, begin + at + ahead + inner - had
                position += take
                inner += take
                window += 1


def sequence_of(tape: int, total: int, width: int) -> tuple[int, int, int]:
    """(sequence_id, offset, tokens left in it) of a place on a tape of `total` tokens.

    Full windows first; the rest is cut into powers of two, so no sequence needs padding.
    """
    full = total // width
    if tape < full * width:
        return tape // width, tape % width, width - tape % width
    rest, at, i = total - full * width, tape - full * width, full
    while True:
        size = 1 << (rest.bit_length() - 1)
        if at < size:
            return i, at, size - at
        at, rest, i = at - size, rest - size, i + 1
