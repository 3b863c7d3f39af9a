"""Match planning: cut blocks into tasks, order them, assign them to reducers."""
