"""Page-by-page restatement of the date rules on plain dictionaries, for small fixtures."""

import calendar
import random
from itertools import product

MONTHS = ["ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC"]
FIELDS = ("log_number", "matricula", "day", "month", "year")


def reading(value, confidence=0.9, status="OK", **more):
    return {"field_type": "ocr", "value": value, "raw_value": value, "confidence": confidence, "status": status, "comment": "OK",
            "source": "ocr", "inference_method": None, "alternatives": [], **more}


def random_pages(seed, books=3, copies=3, files=4):
    """Pages of a few books, some scanned several times, with gaps, doubts, alternatives and wrong years."""
    rng, pages, number = random.Random(seed), [], 0
    for b in range(books):
        day = rng.randint(1, 300)
        for s in sorted(rng.sample(range(50), rng.randint(8, 30))):
            day += rng.choice([0, 0, 1, 1, 2])
            for _ in range(rng.choice([1, 1, 1, copies])):
                number += 1
                year, rest = 24 + day // 365, day % 365
                m = min(rest // 30, 11)
                d = rest % 30 + 1
                log = f"{20000 + b}{s:02d}" if rng.random() > 0.1 else rng.choice([None, "12x", "123"])
                wrong = rng.random() < 0.12
                dd = reading(f"{(d % 28) + 1 if wrong else d:02d}", rng.choice([0.4, 0.6, 0.9]), alternatives=[f"{d:02d}"] if wrong else [])
                parts = {"day": dd, "month": reading(MONTHS[m], rng.choice([0.3, 0.6, 0.9])), "year": reading(f"{year + (3 if rng.random() < 0.1 else 0):02d}", rng.choice([0.4, 0.7]))}
                for f, p in parts.items():
                    roll = rng.random()
                    if roll < 0.18:
                        p.update(value=None, status="ERROR", comment="Required field empty")
                    elif roll < 0.25:
                        p.update(status=rng.choice(["WARNING", "ERROR"]), comment=rng.choice(["month fuzzy: x", "OK"]),
                                 inference_method=rng.choice([None, "date_cells"]) if f == "month" else None)
                pages.append({"file_seq": rng.randrange(files), "file": "f", "page_number": number, "blank": rng.random() < 0.05, "status": "OK", "date": None,
                              "alignment": "low" if rng.random() < 0.05 else "ok", "processing_ms": 1.0, "log_number": reading(log, status="OK" if log else "ERROR"),
                              "matricula": reading("HP-1717CMP"), **parts})
    rng.shuffle(pages)
    return pages


def digits(text):
    return "".join(c for c in text or "" if c.isdigit())


def day_of(v):
    d = digits(v)
    return int(d) if d and 1 <= int(d) <= 31 else None


def month_of(v):
    return MONTHS.index(v) + 1 if v in MONTHS else None


def year_of(v):
    d = digits(v)
    return int(d) if len(d) == 2 else None


NORM = {"day": day_of, "month": month_of, "year": year_of}


def text_of(field, v):
    return MONTHS[v - 1] if field == "month" else f"{v:02d}"


def log_of(p):
    v = p["log_number"]["value"]
    return int(v) if v and len(v) == 7 and v.isdigit() else None


def norm(p, f):
    return NORM[f](p[f]["value"])


def book_of(p):
    n = log_of(p)
    return None if n is None else (n // 100, n % 100 >= 50)


def order(p):
    n = log_of(p)
    return (n if n is not None else 1 << 30, p["page_number"], p["file_seq"])


def is_anchor(p, f):
    x, c = p[f], p[f]["comment"].lower()
    if log_of(p) is None or p["alignment"] != "ok" or norm(p, f) is None or x["source"] in ("inferred", "book_correction") or x["alternatives"]:
        return False
    if x["status"] == "OK" and x["confidence"] >= 0.5 and not any(w in c for w in ("fuzzy", "numeric handwritten month", "low confidence", "conflicts with", "regression")):
        return True
    return (f == "month" and x["status"] == "WARNING" and x["confidence"] >= 0.35 and x["inference_method"] in ("ranuras", "date_cells")
            and not any(w in c for w in ("fuzzy", "numeric handwritten month", "conflict")))


def put(p, f, text, **more):
    x = p[f]
    if x["value"] and x["value"] != text and x["value"] not in x["alternatives"]:
        x["alternatives"].append(x["value"])
    x.update(value=text, status="WARNING", **more)


def resolved(p):
    y, m, d = norm(p, "year"), norm(p, "month"), norm(p, "day")
    return None if None in (y, m, d) else (2000 + y, m, d)


def date_of(p):
    r = resolved(p)
    if r is None or any(p[f]["status"] == "ERROR" for f in NORM) or r[2] > calendar.monthrange(r[0], r[1])[1]:
        return None
    return "%04d/%02d/%02d" % r


def sequence(book):
    import datetime
    rows = []
    for p in sorted((p for p in book if log_of(p) is not None), key=order):
        lists = []
        for f in ("day", "month", "year"):
            seen = []
            for raw in [p[f]["value"], *p[f]["alternatives"]]:
                v = NORM[f](raw)
                if v is not None and v not in seen:
                    seen.append(v)
            lists.append(seen)
        options = []
        for d, m, y in product(*lists):
            try:
                options.append((datetime.date(2000 + y, m, d), {"day": d, "month": m, "year": y}))
            except ValueError:
                pass
        if options:
            rows.append((p, options))
    if len(rows) < 2:
        return
    def changed(p, o):
        return sum(norm(p, f) != o[f] for f in NORM)
    # Every state keeps its whole path: slow and plain.
    states = [((0, changed(rows[0][0], o), 0), d, [(d, o)]) for d, o in rows[0][1]]
    for p, options in rows[1:]:
        following = []
        for d, o in options:
            reached = [((c[0] + (d < q), c[1] + changed(p, o), c[2] + abs((d - q).days)), d, [*path, (d, o)]) for c, q, path in states]
            following.append(min(reached, key=lambda s: s[0]))
        states = following
    best = min(states, key=lambda s: s[0])
    now = sum(b[1][0][0] < a[1][0][0] for a, b in zip(rows, rows[1:]))
    if best[0][0] >= now:
        return
    for (p, _), (_, o) in zip(rows, best[2]):
        for f in NORM:
            if norm(p, f) != o[f]:
                put(p, f, str(o[f]) if f == "day" else text_of(f, o[f]), source="book_correction", inference_method="log_number_sequence_candidate")


def years(book):
    read = [p for p in sorted(book, key=order) if log_of(p) is not None and not p["blank"] and norm(p, "year") is not None]
    count = {}
    for p in read:
        count[norm(p, "year")] = count.get(norm(p, "year"), 0) + 1
    if len(read) < 3:
        return
    ranked = sorted(count.values(), reverse=True) + [0]
    top = max(count, key=count.get)
    if ranked[0] < 2 or ranked[0] == ranked[1] or ranked[0] / len(read) < 0.6:
        return
    at = [i for i, p in enumerate(read) if norm(p, "year") == top]
    for i, p in enumerate(read):
        delta = norm(p, "year") - top
        if delta and not (delta == -1 and i < at[0]) and not (delta == 1 and i > at[-1]):
            put(p, "year", text_of("year", top), source="book_correction", inference_method="log_number_year_consensus", confidence=round(min(0.95, 0.55 + ranked[0] / len(read) * 0.4), 3))


def anchors(book, f):
    return sorted(((log_of(p), p["page_number"], p["file_seq"], norm(p, f), id(p)) for p in book if is_anchor(p, f)))


def between(book, f):
    known = anchors(book, f)
    for p in sorted((p for p in book if log_of(p) is not None), key=order):
        n = log_of(p)
        left, right = [a for a in known if a[0] < n], [a for a in known if a[0] > n]
        if p["alignment"] != "ok" or not left or not right or left[-1][3] != right[0][3]:
            continue
        v = left[-1][3]
        if any(a[0] == n and a[4] != id(p) and a[3] != v for a in known):
            continue
        if norm(p, f) is not None and p[f]["status"] != "ERROR":
            if norm(p, f) != v:
                p[f].update(status="WARNING", inference_method="log_number_interval_conflict", comment=p[f]["comment"] + " | Conflicts with")
        else:
            put(p, f, text_of(f, v), source="inferred", inference_method="log_number_interval")


def edges(book, f):
    known = anchors(book, f)
    if len(known) < 2:
        return
    for two, near, before in ((known[:2], known[0][0], True), (known[-2:], known[-1][0], False)):
        if two[0][3] == two[1][3]:
            for p in book:
                n = log_of(p)
                if n is not None and p["alignment"] == "ok" and (n < near if before else n > near) and abs(n - near) <= 10 and (norm(p, f) is None or p[f]["status"] == "ERROR"):
                    put(p, f, text_of(f, two[0][3]), source="inferred", inference_method="log_number_local_consensus")


def fill_all(book, f, known):
    if len(known) >= 2 and len({a[3] for a in known}) == 1:
        for p in book:
            if not p["blank"] and norm(p, f) is None:
                put(p, f, text_of(f, known[0][3]), source="inferred", inference_method="book_consensus")


def days(book):
    line = sorted((p for p in book if not p["blank"]), key=order)
    for i, p in enumerate(line):
        y, m = norm(p, "year"), norm(p, "month")
        if norm(p, "day") is not None or y is None or m is None:
            continue
        def near(seq):
            r = next((resolved(q) for q in seq if resolved(q)), None)
            return r[2] if r and r[:2] == (2000 + y, m) else None
        last = calendar.monthrange(2000 + y, m)[1]
        after, before = near(line[i + 1:]), near(line[:i][::-1])
        day = min(last, after if after is not None else last)
        put(p, "day", f"{max(day, before) if before is not None else day:02d}", source="inferred", inference_method="month_end_fallback")


def correct(pages):
    groups = {}
    for p in pages:
        groups.setdefault(book_of(p), []).append(p)
    known = [k for k in groups if k is not None]
    if len(known) == 1 and None in groups:
        groups[known[0]].extend(groups.pop(None))
    for book in groups.values():
        book.sort(key=order)
        years(book)
        sequence(book)
        before = {f: anchors(book, f) for f in ("year", "month")}
        for f in ("year", "month"):
            between(book, f)
            edges(book, f)
            fill_all(book, f, before[f])
        days(book)
        previous = None
        for p in sorted((p for p in book if log_of(p) is not None), key=order):
            d = date_of(p)
            if d and previous and d < previous:
                p["year"].update(status="WARNING", inference_method="log_number_regression")
            previous = d or previous
        for p in book:
            p["date"] = date_of(p) if not p["blank"] else p["date"]
            if not p["blank"] and p["date"] is None:
                for f, method in (("day", "date_incomplete"), ("month", "date_unresolved"), ("year", "date_unresolved")):
                    if norm(p, f) is None:
                        p[f].update(status="WARNING", inference_method=method)
                if resolved(p):
                    p["year"].update(status="WARNING", inference_method="invalid_calendar_date")
    return pages
