"""Image files: NIfTI, AFNI and NIML."""
