"""A writer of small .xls files for tests: BIFF records in an OLE2 file."""

import struct

FREE, END, FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def record(kind, raw):
    return struct.pack("<2H", kind, len(raw)) + raw


def text(value, length="<H", wide=None):
    wide = any(ord(c) > 255 for c in value) if wide is None else wide
    return struct.pack(length, len(value)) + bytes([wide]) + value.encode("utf-16-le" if wide else "latin-1")


def shared_strings(values, limit):
    """SST and its continuations, cut after `limit` bytes wherever that is, characters included."""
    parts, room = [struct.pack("<2I", len(values), len(values))], limit - 8
    for n, value in enumerate(values):
        wide = any(ord(c) > 255 for c in value)
        rich = n % 3 == 1  # a format run and a sound after the characters
        head = struct.pack("<HB", len(value), wide | (12 if rich else 0)) + (struct.pack("<HI", 1, 5) if rich else b"")
        if room < len(head) + 2:
            parts.append(b"")
            room = limit
        parts[-1] += head
        room -= len(head)
        rest, step = value, 2 if wide else 1
        while rest:
            fits = room // step
            if not fits:
                wide = any(ord(c) > 255 for c in rest)  # the flag may change in a new part
                step = 2 if wide else 1
                parts.append(bytes([wide]))
                room = limit - 1
                continue
            parts[-1] += rest[:fits].encode("utf-16-le" if wide else "latin-1")
            room -= min(fits, len(rest)) * step
            rest = rest[fits:]
        for b in b"\1\2\3\4sound" if rich else b"":
            if not room:
                parts.append(b"")
                room = limit
            parts[-1] += bytes([b])
            room -= 1
    return b"".join(record(0xFC if not k else 0x3C, p) for k, p in enumerate(parts))


def cell(row, col, value, shared):
    at = struct.pack("<3H", row, col, 0)
    if isinstance(value, bool):
        return record(0x205, at + bytes([value, 0]))
    if isinstance(value, tuple):  # a formula with its result
        if isinstance(value[0], str):
            return record(0x06, at + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + record(0x207, text(value[0]))
        return record(0x06, at + struct.pack("<d", value[0]) + bytes(8))
    if isinstance(value, int):
        return record(0x27E, at + struct.pack("<i", value << 2 | 2))
    if isinstance(value, float):
        cents = round(value * 100)
        if cents / 100 == value and abs(cents) < 1 << 28:
            return record(0x27E, at + struct.pack("<i", cents << 2 | 3))
        return record(0x203, at + struct.pack("<d", value))
    if value is None:
        return record(0x205, at + bytes([42, 1]))
    return record(0xFD, at + struct.pack("<I", shared.index(value))) if value in shared else record(0x204, at + text(value))


def workbook(sheets, limit=8224, labels=()):
    """sheets: name -> {(row, col): value}; values in labels are written in the cell and not shared."""
    shared = list(dict.fromkeys(v for s in sheets.values() for v in s.values() if isinstance(v, str) and v not in labels))
    bof = lambda kind: record(0x809, struct.pack("<2H12x", 0x600, kind))
    bodies = [bof(0x10) + b"".join(cell(r, c, v, shared) for (r, c), v in sorted(s.items())) + record(0x0A, b"") for s in sheets.values()]
    strings = shared_strings(shared, limit)
    heads = [struct.pack("<IBB", 0, 0, 0) + text(n, "B") for n in sheets]
    at = len(bof(5)) + sum(4 + len(h) for h in heads) + len(strings) + 4
    out = bof(5)
    for h, body in zip(heads, bodies):
        out += record(0x85, struct.pack("<I", at) + h[4:])
        at += len(body)
    return out + strings + record(0x0A, b"") + b"".join(bodies)


def compound(stream, name="Workbook", pad=0):
    """An OLE2 file of one stream, in small sectors if it is short; pad adds unused sectors, so that the
    table of sectors needs a table of its own."""
    small = len(stream) < 4096
    root_stream = stream.ljust(-(-len(stream) // 64) * 64, b"\0") if small else b""
    blocks = lambda raw: [raw[k : k + 512].ljust(512, b"\0") for k in range(0, len(raw), 512)]
    data = blocks(root_stream if small else stream)
    n_mini = len(root_stream) // 64
    mini_table = blocks(struct.pack(f"<{n_mini}I", *[*range(1, n_mini), END]).ljust(512, b"\xff")) if small else []
    n_body = 1 + len(data) + len(mini_table) + pad
    n_fat = 1
    while n_fat * 128 < n_body + n_fat + max(0, -(-(n_fat - 109) // 127)):
        n_fat += 1
    n_difat = max(0, -(-(n_fat - 109) // 127))
    first_data, first_mini = 1, 1 + len(data)
    first_fat, first_difat = n_body, n_body + n_fat

    def entry(label, kind, start, size):
        raw = label.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw) + 2, kind, 1, FREE, 1 if kind == 5 else FREE, FREE).ljust(52, b"\0")[:52][: 116 - 64] + struct.pack("<IQ", start, size)

    chain = lambda first, n: [*range(first + 1, first + n), END] if n else []
    table = [END] + chain(first_data, len(data)) + chain(first_mini, len(mini_table)) + [FREE] * pad + [FAT] * n_fat + [0xFFFFFFFC] * n_difat
    table += [FREE] * (n_fat * 128 - len(table))
    folder = (entry("Root Entry", 5, first_data if small else END, len(root_stream)) + entry(name, 2, 0 if small else first_data, len(stream))).ljust(512, b"\0")
    fats = list(range(first_fat, first_fat + n_fat))
    difats = [fats[109 + 127 * k :][:127] for k in range(n_difat)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H6x", 0x3E, 3, 0xFFFE, 9, 6) + struct.pack("<I", 0)
    head += struct.pack("<8I", n_fat, 0, 0, 4096, first_mini if small else END, len(mini_table), first_difat if n_difat else END, n_difat)
    head += struct.pack("<109I", *(fats[:109] + [FREE] * max(0, 109 - n_fat)))
    more = [struct.pack("<128I", *(d + [FREE] * (127 - len(d))), first_difat + k + 1 if k + 1 < n_difat else END) for k, d in enumerate(difats)]
    return head + folder + b"".join(data) + b"".join(mini_table) + bytes(512 * pad) + struct.pack(f"<{len(table)}I", *table) + b"".join(more)
