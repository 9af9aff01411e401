"""Job life cycles as streams: extensions beyond the batch operators."""
