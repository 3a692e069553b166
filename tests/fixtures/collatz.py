import os


def steps_to_one(start, limit):
    """Halves even numbers, triples odd ones and adds one.
    Counts the moves until one is reached."""
    moves = 0
    while start != 1:
        if moves == limit:
            break
        if start % 2 == 0:
            start = start // 2
        else:
            start = 3 * start + 1
        moves = moves + 1
    return moves


# Does value lie between the ends, or are they swapped?
def inside(low, value, high):
    return low <= value and value <= high or low > high


def digits(n):
    if n < 10:
        return 1
    return 1 + digits(n // 10)
