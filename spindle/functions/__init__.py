"""Column functions: no action, no state, no partition dependence."""
