def groups(fps, bits=2):
    """Brute-force groups of fingerprints that differ in `bits` bits or fewer: {id: smallest id of its group}."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, x in enumerate(ids):
        for y in ids[k + 1:]:
            if (fps[x] ^ fps[y]).bit_count() <= bits:
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: root(i) for i in ids}
