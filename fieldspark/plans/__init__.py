"""Named analyses: climate, samples, zones, modelling tables, peaks, spatial tables, figure data."""
