"""Row-level and window-level operators over bars."""
