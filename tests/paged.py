"""A remote listing for tests."""

ROWS = [(str(i), f"c{i}", "{}") for i in range(5)]


def fetch(page: int, size: int) -> list[tuple]:
    return ROWS[page * size : (page + 1) * size]
