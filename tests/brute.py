"""Small random networks, and what is true of them by following every packet one by one."""

import random
from itertools import product

BASE = 203 << 24 | 113 << 8  # 203.0.113.0
BEYOND = [0, BASE + 256]  # addresses outside of all but default routes


def dotted(x):
    return ".".join(str(x >> by & 255) for by in (24, 16, 8, 0))


def holds(prefix, x):
    lo, width = prefix
    return x >> (32 - width) == lo >> (32 - width)


def closure(edges):
    """Pairs joined by a walk of one edge or more."""
    found = set(edges)
    while more := {(a, d) for a, b in found for c, d in edges if b == c} - found:
        found |= more
    return found


class Routed:
    """Routers with tables over 203.0.113.0/24: equal-cost routes, holes, drops, local subnets, aliases."""

    def __init__(self, seed):
        r = self.random = random.Random(seed)
        self.names = [f"{w}{seed}" for w in ("ash", "birch", "cedar", "elm", "fir", "hazel", "oak")][: r.randint(4, 7)]
        self.own = {n: BASE + 200 + k for k, n in enumerate(self.names)}
        self.alias = {n: (10 << 24) + 77 + k for k, n in enumerate(self.names) if r.random() < 0.5}
        self.host = {x: n for n, x in [*self.own.items(), *self.alias.items()]}
        self.rows = {n: [((self.own[n], 32), None, "loopback 3", "merged")] for n in self.names}
        for n in self.names:
            for _ in range(r.randint(2, 6)):
                width = r.choice([0, 24, 25, 26, 26, 27, 28]) if seed % 2 else r.choice([24, 25, 26, 27, 28])
                prefix = (BASE + r.randrange(256) >> (32 - width) << (32 - width) if width else 0, width)
                other = r.choice([o for o in self.names if o != n])
                to = r.choice([self.own[other]] * 4 + [self.alias.get(other, self.own[other])] * 2 + [(172 << 24) + r.randrange(9)])
                what = r.choice(["gateway"] * 6 + ["drop"] + ["lan"] * bool(width))
                if what == "gateway":
                    self.rows[n].append((prefix, to, f"p{r.randrange(3)}", self.host.get(to, "merged")))
                else:
                    self.rows[n].append((prefix, None, "drop" if what == "drop" else "vlan9", "drop" if what == "drop" else "merged"))
        self.listed = [(BASE + 64 * k, BASE + 64 * k + 64) for k in range(4) if r.random() < 0.3]
        self.listed += [(0, BASE), (BASE + 256, 1 << 32)] * (seed % 4 > 1)  # else what nobody routes is lost everywhere
        self.addresses = [BEYOND[0], *range(BASE, BASE + 256), BEYOND[1], *sorted(self.alias.values())]

    def write(self, folder):
        lines = lambda n: [f"{dotted(p[0])}/{p[1]},{'DIRECT' if to is None else dotted(to)},{face},T" for p, to, face, _ in self.rows[n]]
        for n in self.names:
            (folder / f"{n}.csv").write_text("% a table\n" + "\n".join(lines(n)) + "\n")
        (folder / "hosts.csv").write_text("".join(f"{n},{dotted(self.own[n])},{dotted(x)}\n" for n, x in self.alias.items()))
        pairs = [(a, b) for a in self.names for b in self.names if a < b]
        (folder / "pairs.csv").write_text("".join(f"{a},{b}\n" for a, b in pairs) + "nobody," + self.names[0] + "\n")
        nodes = "".join(f'<node name="{n}" file="{n}.csv"/>' for n in self.names)
        (folder / "manifest.xml").write_text(f'<manifest><data><resolver file="hosts.csv"/><pair-list file="pairs.csv"/>{nodes}</data></manifest>')
        return f"file://{folder}/manifest.xml"

    def hops(self, name, x):
        met = [(p[1], to) for p, _, _, to in self.rows.get(name, []) if holds(p, x)]
        return {to for w, to in met if w == max(met)[0]}

    def edges(self):
        return {(n, to) for n in self.names for _, _, _, to in self.rows[n]}

    def asked(self):
        """Addresses that are not listed, in order."""
        return [x for x in sorted(self.addresses) if not any(lo <= x < hi for lo, hi in self.listed)]

    def ways(self, x):
        return closure({(n, to) for n in self.names for to in self.hops(n, x)})

    def loops(self, max_edges=None):
        """name -> smallest address that comes back within so many edges, for those on a cycle of the graph within as many."""
        bound = max_edges or 99

        def back(edges, n):
            at, seen = {n}, set()
            for _ in range(bound):
                at = {b for a, b in edges if a in at}
                if n in at:
                    return True
                if at <= seen:
                    return False
                seen |= at
            return False

        judged = [n for n in self.names if back(self.edges(), n)]
        return {n: next((x for x in self.asked() if back({(m, to) for m in self.names for to in self.hops(m, x)}, n)), None) for n in judged}

    def losses(self):
        judged = [n for n in self.names if (n, "merged") in closure(self.edges())]
        return {n: next((x for x in self.asked() if (n, "merged") not in self.ways(x)), None) for n in judged}

    def backward(self, x, target, bound, allowed):
        """Routers with a walk to the target whose every edge is allowed at its step, counted from the end."""
        steps = [(n, to) for n in self.names for to in self.hops(n, x)]
        at, seen = {target}, set()
        for hop in range(1, bound + 1):
            at = {a for a, b in steps if b in at and allowed(a, hop)}
            seen |= at
        return seen

    def constrained(self, allowed):
        """(loops, losses) as ``loops`` and ``losses`` with edges that must be allowed."""
        n = len(self.names)
        cyclic, sinks = [r for r in self.names if (r, r) in closure(self.edges())], [r for r in self.names if (r, "merged") in closure(self.edges())]
        found = {r: next((x for x in self.asked() if r in self.backward(x, r, n, allowed)), None) for r in cyclic}
        return found, {r: next((x for x in self.asked() if r not in self.backward(x, "merged", n, allowed)), None) for r in sinks}

    def inconsistent(self):
        found = {}
        for a in self.names:
            for b in self.names:
                if a < b:
                    found[f"{a} {b}"] = next((x for x in self.asked() if ((a, "merged") in self.ways(x)) != ((b, "merged") in self.ways(x))), None)
        return found


FIELDS, WIDTHS = ["dst_ip", "src_ip", "dst_port", "src_port", "tag"], [32, 32, 16, 16, 1]
NAMES = ["dest", "src", "dst-port", "src-port"]


class Filtered:
    """Routers with interfaces, access lists, NAT and set-field rules on headers of five fields."""

    def __init__(self, seed, routers=4, with_nat=True):
        r = self.random = random.Random(seed)
        self.n = routers
        self.faces = []  # router, if_id, nexthop, prefixes, acl, nat, setfield
        for a in range(routers):
            near = r.sample([b for b in range(routers) if b != a], r.randint(1, min(2, routers - 1)))
            for k, b in enumerate(near):
                fib = [self.prefix([0, 25, 26, 26, 27]) for _ in range(r.randint(1, 2))]
                acl = [(r.choice(["accept", "deny"]), self.conditions()) for _ in range(r.choice([0, 0, 1, 2, 3]))]
                nat = [(self.prefix([0, 25, 26]), self.prefix([26, 27, 32])) for _ in range(r.randint(1, 2))] if with_nat and r.random() < 0.3 else []
                rules = []
                if r.random() < 0.4:
                    rules = [(f, "identical", None) for f in range(5) if r.random() < 0.8 and not (nat and f == 0)]
                    if r.random() < 0.7:
                        rules.append((4, "set", (r.choice([0, 1]), r.choice([0, 1]))))
                        rules = [x for x in rules if x[0] != 4 or x[1] == "set"]
                        rules[-1] = (4, "set", (v := rules[-1][2][0], v + 1))
                self.faces.append((a, 10 * a + k, b, fib, acl, nat, rules))
        self.values = [sorted({0} | {x for x in self.constants(f) if x < 1 << w}) for f, w in enumerate(WIDTHS)]

    def prefix(self, widths):
        width = self.random.choice(widths)
        return (BASE + self.random.randrange(128) >> (32 - width) << (32 - width) if width else 0, width)

    def conditions(self):
        r, out = self.random, []
        if r.random() < 0.6:
            lo, width = self.prefix([25, 26, 27])
            out.append((0, (lo, lo + (1 << 32 - width))))
        if r.random() < 0.5:
            port = r.choice([53, 8080])
            out.append((2, (port, port + 1)))
        if r.random() < 0.3:
            bit = r.choice([0, 1])
            out.append((4, (bit, bit + 1)))
        return out

    def constants(self, f):
        span = lambda p: (p[0], p[0] + (1 << 32 - p[1]))
        for _, _, _, fib, acl, nat, rules in self.faces:
            if f == 0:
                for p in [*fib, *(p for pair in nat for p in pair)]:
                    yield from span(p)
            for g, (lo, hi) in [c for _, some in acl for c in some] + [(g, v) for g, op, v in rules if op == "set"]:
                if g == f:
                    yield from (lo, hi)

    def document(self):
        def field(f, lo, hi, op=""):
            name = f'name="{NAMES[f]}"' if f < 4 else f'id="{f}"'
            body = f"<prefix>{dotted(lo)}/{33 - (hi - lo).bit_length()}</prefix>" if f < 2 else f'<integer value="{lo}" length="{WIDTHS[f]}"/>'
            return f"<field {name}{op}>{body}</field>"

        text = lambda p: f"{dotted(p[0])}/{p[1]}"
        out = []
        for a in range(self.n):
            inner = ""
            for router, i, b, fib, acl, nat, rules in self.faces:
                if router == a:
                    inner += f'<interface id="{i}" nexthop_id="{b}">' + "".join(f'<fib dest="{text(p)}"/>' for p in fib)
                    inner += "".join(f'<acl action="{act}">' + "".join(field(f, lo, hi, ' op="eq"') for f, (lo, hi) in some) + "</acl>" for act, some in acl)
                    inner += "".join(f'<transformation-nat src="{text(p)}" dest="{text(q)}"/>' for p, q in nat)
                    if rules:
                        same = lambda f: f'<field {f"name={chr(34)}{NAMES[f]}{chr(34)}" if f < 4 else f"id={chr(34)}{f}{chr(34)}"} op="identical"/>'
                        inner += "<transformation-setfield>" + "".join(same(f) if op == "identical" else field(f, *v) for f, op, v in rules) + "</transformation-setfield>"
                    inner += "</interface>"
            out.append(f'<router id="{a}" name="r{a}">{inner}</router>')
        return f"<test><network>{''.join(out)}</network></test>"

    def leaves(self, face, packet):
        """Whether a packet is routed to an interface and let through."""
        widths = [(p[1], i) for router, i, _, fib, *_ in self.faces if router == face[0] for p in fib if holds(p, packet[0])]
        if not any(i == face[1] and w == max(widths)[0] for w, i in widths):
            return False
        for action, some in face[4]:
            if all(lo <= packet[f] < hi for f, (lo, hi) in some):
                return action == "accept"
        return True

    def before(self, face, packet):
        """Packets that may be this one after the interface's changes."""
        _, _, _, _, _, nat, rules = face
        if not nat and not rules:
            yield packet
            return
        free = [list(v) for v in self.values]
        if nat:
            outer = [p for p, q in nat if holds(q, packet[0])]
            free[0] = [x for x in free[0] if any(holds(p, x) for p in outer)]
        for f, op, v in rules:
            if op == "identical":
                free[f] = [packet[f]] if packet[f] in free[f] else []
            elif not v[0] <= packet[f] < v[1]:
                return
        yield from product(*free)

    def reached(self, target):
        """node -> {packet at the node: packet with which it gets to the target, any}, within as many edges as routers."""
        arrivals = {}
        edges = []
        for face in self.faces:
            edges += [(face[0], p, face[2], q) for q in product(*self.values) if self.leaves(face, q) for p in self.before(face, q)]
        for q in product(*self.values):
            state = {(target, q)}
            seen = set()
            for _ in range(self.n):
                state = {(a, p) for a, p, b, o in edges if (b, o) in state}
                seen |= state
            for a, p in seen:
                arrivals.setdefault(a, set()).add((p, q))
        return arrivals

    def connected(self):
        return {(a, b) for a, b in closure({(f[0], f[2]) for f in self.faces}) if a != b}

    def all_pairs(self):
        """(src, dst) -> whether some packet gets there; by states, not by paths."""
        steps = {}
        for face in self.faces:
            for q in product(*self.values):
                if self.leaves(face, q):
                    for p in self.before(face, q):
                        steps.setdefault((face[2], q), set()).add((face[0], p))
        out = {}
        for t in range(self.n):
            state, seen = {(t, q) for q in product(*self.values)}, set()
            for _ in range(self.n):
                state = {s for x in state for s in steps.get(x, ())} - seen
                seen |= state
            out |= {(a, t): any(n == a for n, _ in seen) for a, b in self.connected() if b == t}
        return out
