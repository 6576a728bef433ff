"""Images from streams of events. This goes beyond the batch operators: volumes appear as their day closes."""
