"""Row-wise functions of signals."""
