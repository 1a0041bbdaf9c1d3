"""Plans that take more than one job: numbering, lattice search."""
