"""No streaming operators: a time step needs the complete state before it, so a
run is a loop over batches (see plans.simulate), not a stream."""
