"""A plain sequential model of the segmentation, pixel by pixel, for small images (dicts and loops only)."""

import math


def start(h, w, k):
    """Rules of the first grid, as in the survey: rows by the square root, remainders to rows 0, 2, 4, ... and then 1, 3, ..."""
    n_rows = int(math.sqrt(k))
    per = {r: k // n_rows for r in range(n_rows)}
    for r in ([*range(0, n_rows, 2), *range(1, n_rows, 2)])[: k % n_rows]:
        per[r] += 1
    height, out = math.ceil(h / n_rows), []
    y, r = 0, 0
    while y < h:
        width, x = math.ceil(w / per[r]), 0
        while x < w:
            out.append((min(y + height // 2, h - 1), min(x + width // 2, w - 1)))
            x += width
        y, r = y + height, r + 1
    out = out[:k]
    while len(out) < k:
        out.append((h // 2, w // 2))
    return out


class Model:
    def __init__(self, image, config, clusters=None):
        """image: rows of (c0, c1, c2) as they are compared; clusters: (y, x) by number."""
        self.image, self.c = image, config
        self.h, self.w = len(image), len(image[0])
        self.s = math.isqrt(self.h * self.w // config.num_components)
        self.coef, self.table = config.spatial_coefficient(self.s), config.spatial_table(self.s)
        self.clusters = [{"y": float(y), "x": float(x), "n": 0} for y, x in (clusters or start(self.h, self.w, config.num_components))]
        self.label = {(y, x): None for y in range(self.h) for x in range(self.w)}

    def run(self, max_iter):
        for c in self.clusters:
            c["y"], c["x"] = min(max(c["y"], 0.0), self.h - 1.0), min(max(c["x"], 0.0), self.w - 1.0)
            c["c"] = [float(v) for v in self.image[int(c["y"])][int(c["x"])]]
            c["active"], c["left"] = True, 2
        if self.c.variant == "lsc":
            self.map_features()
        stride = self.c.subsample_stride
        for i in range(max_iter):
            self.assign(stride, i % stride)
            self.update(stride, i % stride, i == 0)
        for c in self.clusters:
            c["active"] = True
        self.assign(1, 0)

    def raw(self, y, x):
        v, q = self.image[y][x], math.pi / 2
        a = [(v[0] * (q / 255), 20.0), (v[1] * (q / 255), 51.0), (v[2] * (q / 255), 51.0)]
        a += [(t * (q / self.s), 20.0 * self.c.compactness / 100) for t in (x, y)]
        return [f(t) * g for t, g in a for f in (math.cos, math.sin)]

    def map_features(self):
        raw = {p: self.raw(*p) for p in self.label}
        mean = [sum(r[f] for r in raw.values()) / len(raw) for f in range(10)]
        self.weight = {p: sum(m * v for m, v in zip(mean, r)) for p, r in raw.items()}
        self.feat = {p: [v / self.weight[p] for v in r] for p, r in raw.items()}
        for c in self.clusters:
            near = [p for p in self.label if abs(p[0] - int(c["y"])) <= self.s // 4 and abs(p[1] - int(c["x"])) <= self.s // 4]
            c["f"] = [sum(self.feat[p][f] for p in near) / len(near) for f in range(10)]

    def inside(self, c, y, x):
        if self.c.variant == "noq":
            ok = lambda v, at: int(max(at - self.s, 0.0)) <= v < int(at + self.s + 1)
            return ok(y, c["y"]) and ok(x, c["x"])
        return abs(y - int(c["y"])) <= self.s and abs(x - int(c["x"])) <= self.s

    def distance(self, c, y, x):
        v = self.c.variant
        if v == "lsc":
            return sum((a - b) ** 2 for a, b in zip(self.feat[y, x], c["f"]))
        keep = (lambda t: t) if v == "noq" else int
        dy, dx = abs(y - keep(c["y"])), abs(x - keep(c["x"]))
        d = [abs(a - keep(b)) for a, b in zip(self.image[y][x], c["c"])]
        if v == "l2" or v == "noq" and not self.c.manhattan_spatial_dist:
            return sum(t * t for t in d) + self.coef * self.coef * (dy * dy + dx * dx)
        far = dy + dx if self.c.manhattan_spatial_dist else math.hypot(dy, dx)
        if v in ("real", "noq"):
            return sum(d) + self.coef * far
        return sum(d) + (self.table[dy + dx] if self.c.manhattan_spatial_dist else math.floor(self.coef * far))

    def assign(self, stride, rem):
        t = 2 * self.s + 32
        cell = lambda c: (int(c["y"]) // t, int(c["x"]) // t)
        numbers = sorted(range(len(self.clusters)), key=lambda k: (2 * (cell(self.clusters[k])[0] % 2) + cell(self.clusters[k])[1] % 2, cell(self.clusters[k]), k))
        for y in range(rem, self.h, stride):
            for x in range(self.w):
                best = math.inf
                for k in numbers:
                    c = self.clusters[k]
                    if c["active"] and self.inside(c, y, x):
                        d = self.distance(c, y, x)
                        if best > d:
                            best, self.label[y, x] = d, k

    def update(self, stride, rem, first):
        wide = 2 * self.s
        every = not self.c.preemptive or first or all(c["active"] for c in self.clusters)
        awake = {(int(c["y"]) // wide, int(c["x"]) // wide) for c in self.clusters if c["active"]}
        mine = {k: [] for k in range(len(self.clusters))}
        for (y, x), k in self.label.items():
            if k is not None and y % stride == rem and (every or (y // wide, x // wide) in awake):
                mine[k].append((y, x))
        old = [(c["y"], c["x"]) for c in self.clusters]
        for k, c in enumerate(self.clusters):
            if not c["left"]:
                continue
            n = c["n"] = len(mine[k])
            if self.c.variant == "lsc":
                w = sum(self.weight[p] for p in mine[k])
                c["f"] = [sum(self.weight[p] * self.feat[p][f] for p in mine[k]) / w if n else math.nan for f in range(10)]
            if n:
                sums = [sum(p[0] for p in mine[k]), sum(p[1] for p in mine[k]), *(sum(self.image[y][x][j] for y, x in mine[k]) for j in range(3))]
                mean = [v / n if self.c.variant == "noq" else float((v + n // 2) // n) for v in sums]
                c["y"], c["x"], c["c"] = mean[0], mean[1], mean[2:]
        if self.c.preemptive:
            limit = max(math.floor(2 * self.s * self.c.preemptive_thres + 0.5), 1)
            for c, (y, x) in zip(self.clusters, old):
                if c["left"]:
                    c["left"] = c["left"] - 1 if abs(c["y"] - y) + abs(c["x"] - x) < limit else 2
            at = [(int(c["y"]), int(c["x"])) for c in self.clusters]
            moving = [p for p, c in zip(at, self.clusters) if c["left"]]
            for p, c in zip(at, self.clusters):
                c["active"] = any(abs(p[0] - q[0]) <= wide and abs(p[1] - q[1]) <= wide for q in moving)


def capped_neighbours(label, h, w, k, cap=12):
    """Neighbour lists, first come first served in raster order, with right, lower and lower right pixels."""
    lists = {n: [] for n in range(k)}
    for y in range(h - 1):
        for x in range(w - 1):
            a = label[y, x]
            for b in (label[y, x + 1], label[y + 1, x], label[y + 1, x + 1]):
                if a is None or b is None or a == b or b in lists[a] or len(lists[a]) >= cap or len(lists[b]) >= cap:
                    continue
                lists[a].append(b)
                lists[b].append(a)
    return lists
