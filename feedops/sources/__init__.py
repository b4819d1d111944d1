"""Reading: file inventories, feeds as text, reports, staged tables."""
